"""``python -m quillspark.cli IN OUT``: read a folder, repair what the metrics find, write texts and reports."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import loop, visual
from quillspark.session import session
from quillspark.sources import filetype, readers, sinks


def convert(spark: SparkSession, source: str, glob: str = "*", rounds: int = 3) -> DataFrame:
    """path, text, total_score, rounds, normalizations, errors for each file below a folder; files that no parser reads have null text."""
    parsed = readers.read_with_fallback(spark, source, glob)
    known = parsed.filter("content IS NOT NULL").select("path", F.coalesce("extracted_text", "content").alias("source"), F.col("content").alias("candidate"), filetype.source_class(F.col("media_type"), F.col("path")).alias("source_class"))
    final = loop.finalize(loop.run(known, ["path"], rounds), ["path"])
    return parsed.select("path", "parser_name", "errors").join(final.select("path", "text", "total_score", "rounds", "normalizations"), "path", "left")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source", help="folder to read")
    p.add_argument("target", help="folder to write to")
    p.add_argument("--glob", default="*")
    p.add_argument("--rounds", type=int, default=3)
    p.add_argument("--run-id", default="run")
    p.add_argument("--graph", action="store_true", help="print the control graph and leave")
    a = p.parse_args(argv)
    if a.graph:
        print(visual.graph_mermaid())
        return 0
    spark = session("quillspark")
    out = convert(spark, a.source, a.glob, a.rounds)
    sinks.write_artifacts(out.withColumn("folder", visual.output_folder(F.col("path"), a.target)).withColumn("run_id", F.lit(a.run_id)), a.target)
    done = spark.read.parquet(a.target).filter(F.col("run_id") == a.run_id)
    row = done.agg(F.count("*").alias("n"), F.count("text").alias("k"), F.avg("total_score").alias("s")).first()
    print(f"{row.k} of {row.n} files written to {a.target}, mean score {row.s if row.s is None else round(row.s, 4)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
