"""Judges and recoveries as plug-ins: what they are shown, and how their answers are read.

A judge is any function from a DataFrame of (keys, prompt) to (keys, answer).  ``offline_judge`` is a
deterministic stand-in.  Reading answers is native: JSON paths over the first
object found in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as T
from quillspark.functions.labels import TABLE_ISSUES

Judge = Callable[[DataFrame, list[str]], DataFrame]
FIELDS = ["overall_score", "text_coverage_score", "table_score", "structure_score", "hallucination_score"]
#: Fixed gates of recovered tables and rewritten text.
LEAST_CONFIDENCE, LEAST_GROUNDING, LEAST_TEXT_CONFIDENCE = 0.45, 0.5, 0.6


def verdict_json(answer: Column) -> Column:
    """The answer itself if it is an object, else the fenced one, else from the first to the last brace; null if none parses."""
    whole, fenced = F.trim(answer), F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))
    good = lambda c: F.when(F.ltrim(c).startswith("{") & F.json_object_keys(c).isNotNull(), c)
    return F.coalesce(good(whole), good(fenced), good(braces))


def verdict(answer: Column) -> Column:
    """Scores (clamped, null if absent), issues and table findings."""
    j = verdict_json(answer)
    finding = "array<struct<issue_type:string,table_label:string,page_number:int>>"
    return F.struct(
        *(S.optional_score(F.get_json_object(j, f"$.{f}")).alias(f) for f in FIELDS),
        string_list(F.get_json_object(j, "$.issues")).alias("issues"),
        F.filter(F.coalesce(F.from_json(F.get_json_object(j, "$.table_findings"), finding), F.array().cast(finding)), lambda x: x["issue_type"].isin(list(TABLE_ISSUES))).alias("table_findings"),
    )


def string_list(value: Column) -> Column:
    """Null is empty, a JSON list its items, any other value one item."""
    return F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), F.array(value))).otherwise(F.array(value))


def distinct_findings(findings: Column) -> Column:
    """First of each (type, label, page)."""
    return F.array_distinct(findings)


def evidence(text: Column, limit: int, segments: int = 4) -> Column:
    """The whole text if short, else evenly spaced segments within the limit."""
    size = max(300, limit // segments)
    start = lambda k: F.round(F.greatest(F.length(text) - size, F.lit(0)) * k / max(1, segments - 1)).cast("int")
    parts = [F.concat(F.lit(f"[Document segment {k + 1}/{segments}]\n"), F.substring(text, start(k) + 1, F.lit(size))) for k in range(segments)]
    return F.when(F.length(text) <= limit, text).otherwise(F.left(F.concat_ws("\n\n---\n\n", *parts), F.lit(limit)))


def offline_judge(prompts: DataFrame, keys: list[str]) -> DataFrame:
    """A constant verdict with a score from the prompt's length: for tests and dry runs."""
    score = F.format_number(0.5 + (F.length("prompt") % 50) / 100.0, 2)
    return prompts.select(*keys, F.concat(F.lit('```json\n{"overall_score": '), score, F.lit(', "issues": ["offline"]}\n```')).alias("answer"))


def judged(df: DataFrame, keys: list[str], source: str, candidate: str, judge: Judge = offline_judge, limit: int = 12_000) -> DataFrame:
    """df with the judge's verdict; a failed or unreadable answer gives nulls."""
    prompts = df.select(*keys, F.concat(F.lit("SOURCE\n"), evidence(F.col(source), limit), F.lit("\n\nCANDIDATE\n"), evidence(F.col(candidate), limit)).alias("prompt"))
    return df.join(judge(prompts, keys).select(*keys, verdict(F.col("answer")).alias("verdict")), keys, "left")


def accept_recovery(text_before: Column, text_after: Column, confidence: Column, grounding: Column, table: Column) -> Column:
    """Why a recovered table is rejected; null if it is accepted."""
    rows = F.filter(T.lines(table), T.strict_row)
    shaped = F.lower(table).contains("<table") | ((F.size(rows) >= 2) & F.coalesce(T.separator_cells(F.filter(T.cells(F.get(rows, F.lit(1))), lambda c: c != "")), F.lit(False)))
    return (
        F.when(table.isNull() | T.blank(F.coalesce(table, F.lit(""))), "empty_recovery").when(confidence < LEAST_CONFIDENCE, "low_confidence").when(grounding < LEAST_GROUNDING, "low_grounding")
        .when(~shaped, "not_a_table").when(text_before == text_after, "patch_changed_nothing")
    )


def accept_rewrite(before: Column, after: Column, confidence: Column, most: float = 3.5) -> Column:
    ratio = F.length(after) / F.nullif(F.length(before), F.lit(0)).cast("double")
    return (before != after) & (confidence >= LEAST_TEXT_CONFIDENCE) & F.coalesce((ratio >= 0.3) & (ratio <= most), F.lit(False))
