"""Usage of model calls, feedback records and prompt hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: keyword groups and the hints they give.
HINTS = [
    (["표", "table"], "Pay extra attention to missing table rows, merged cells, and numeric omissions."),
    (["그림", "image", "chart"], "Check whether important figures, maps, or charts were omitted from the candidate output."),
    (["구조", "heading", "section"], "Check heading hierarchy, section continuity, and repeated structural markers carefully."),
]
RECORDS, LEAST = 50, 2


def token_usage(payload: Column) -> Column:
    """(prompt, completion) tokens of a JSON payload in either of two shapes; null if absent or no numbers."""
    pick = lambda a, b: F.coalesce(F.get_json_object(payload, f"$.usage.{a}"), F.get_json_object(payload, f"$.usage.{b}")).try_cast("bigint")
    return F.struct(pick("prompt_tokens", "input_tokens").alias("prompt_tokens"), pick("completion_tokens", "output_tokens").alias("completion_tokens"))


def _sums() -> list[Column]:
    return [
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum("attempts").alias("attempts"), F.sum("duration_ms").alias("duration_ms"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    ]


def usage_by_stage(calls: DataFrame) -> DataFrame:
    """calls: stage, model, duration_ms, ok, attempts, prompt_tokens, completion_tokens."""
    return calls.groupBy("stage").agg(*_sums(), F.array_sort(F.collect_set("model")).alias("models"))


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(*_sums())


def recent(records: DataFrame, order: str, n: int = RECORDS) -> DataFrame:
    """The last n records: a bounded top-n, not a sort of all."""
    return records.orderBy(F.desc(order)).limit(n)


def contains_any(values: Column, needles: list[str]) -> Column:
    """Whether a value contains a needle, case aside."""
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(v).rlike("|".join(needles)))


def prompt_hints(records: DataFrame, order: str) -> DataFrame:
    """One row per hint that at least two of the last records ask for."""
    counted = recent(records, order).agg(*(F.count_if(contains_any(F.col("issues"), words)).alias(f"n{k}") for k, (words, _) in enumerate(HINTS)))
    made = [F.when(F.col(f"n{k}") >= LEAST, F.struct(F.lit(k).alias("position"), F.lit(hint).alias("hint"))) for k, (_, hint) in enumerate(HINTS)]
    return counted.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("h")).select("h.*")
