"""Corpus pipeline: five stages over ``documents``, each a call of one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it again as the next one's documents, so a lost executor
never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, language_id, minhash_dedup, packing, queries, suffix_dedup
from quillspark.llm._store import shared_folder, written

#: Texts whose best prototype is no nearer than this are in no learned language.
LEAST_COSINE = 0.02


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, or like no prototype, go."""
    protos = language_id.prototypes(docs.filter(~language_id.is_held_out(F.col("doc_id"))))
    return language_id.keep_language(docs, protos, least=LEAST_COSINE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return minhash_dedup.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more stays in one document."""
    return suffix_dedup.remove(docs, chars_col="n_chars")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; smaller benchmark spans are cut out of the others."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences and offsets."""
    return packing.pack(docs, **queries.packing_args())


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Tokenizers and hyperdimensional profiles have no SQL form; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{folder}/{k}-{name}")
    return docs
