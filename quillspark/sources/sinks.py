"""Reports and artifacts as tables: partitioned by run, appended, never one file per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Nested report per document as JSON."""
    scores = [c for c in metrics.columns if c not in keys and dict(metrics.dtypes)[c] == "double"]
    lists = [c for c in ("notes", "gate_failures") if c in metrics.columns]
    return metrics.select(*keys, F.to_json(F.struct(F.struct(*scores).alias("metrics"), *lists)).alias("report"))


def artifact_name(stem: Column, suffix: str = "md") -> Column:
    return F.concat(stem, F.lit("." + (suffix.lstrip(".") or "txt")))


def write_artifacts(results: DataFrame, folder: str, run_col: str = "run_id") -> None:
    """Texts and reports of a run as Parquet, partitioned by run."""
    results.write.mode("append").partitionBy(run_col).parquet(folder)


def append_feedback(records: DataFrame, folder: str) -> None:
    """Feedback records as JSON lines."""
    records.write.mode("append").json(folder)


def read_feedback(spark, folder: str) -> DataFrame:
    """Records that parse; malformed lines are dropped."""
    schema = "seq bigint, run_id string, total_score double, issues array<string>, notes array<string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
