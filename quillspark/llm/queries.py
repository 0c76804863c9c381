"""The contract queries: thin digests of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packing_args() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": _tokenizer("byte_bpe_50k.json"), "ranks": _tokenizer("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import quality_rules as op

    return op.report(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import token_counts as op

    counted = op.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), op.WORD_PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > op.LIMIT)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import language_id as op

    docs = _table(spark, sf_dir, "documents")
    protos = op.prototypes(docs.filter(~op.is_held_out(F.col("doc_id"))))
    found = op.predict(docs, protos)
    return found.select("doc_id", op.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import chat_format as op

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return op.report(turns.unionByName(added))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import html_extract as op

    return op.extract(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import decontaminate as op

    return op.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import language_id
    from quillspark.llm import lm_score as op

    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.is_held_out(F.col("doc_id"), 10, 0)
    scored = op.score(docs, op.train(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import packing as op

    return op.pack(_table(spark, sf_dir, "documents"), **packing_args())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import suffix_dedup as op

    return op.report(_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import minhash_dedup as op

    return op.report(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_token_counts, op3_language_id, op4_chat_format, op5_html_extraction, op6_decontamination, op7_lm_score, op8_packing, op9_suffix_dedup, op10_minhash_dedup)
}


def _oracles() -> dict[str, str]:
    from quillspark.llm import chat_format, decontaminate, quality_rules

    return {"op1_quality_rules": quality_rules.REPORT_SQL, "op4_chat_format": chat_format.REPORT_SQL, "op6_decontamination": decontaminate.REPORT_SQL}


ORACLE_SQL: dict[str, str] = _oracles()
