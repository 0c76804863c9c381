"""Scores, severities and planning numbers as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Fixed weights and thresholds of the total score.
WEIGHTS = {"text_coverage": 0.35, "normalized_similarity": 0.35, "structure_retention": 0.15, "table_preservation": 0.15}
JUDGE_WEIGHT, MIN_TOTAL, MIN_COVERAGE, MAX_ROUNDS = 0.25, 0.7, 0.7, 3
STALL_DELTA, DEFAULT_CONFIDENCE = 0.01, 0.55


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return T.let(c, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))))


def count_similarity(expected: Column, actual: Column) -> Column:
    """1 - |e - a| / e, at least 0; with nothing expected, 1 if nothing is there.  Each count is computed once."""

    def score(n: Column) -> Column:
        e, a = n["e"], n["a"]
        return F.when(e == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(clamp(1.0 - F.abs(e - a) / F.nullif(e, F.lit(0.0))))

    return T.let(F.struct(expected.cast("double").alias("e"), actual.cast("double").alias("a")), score)


def total_score(coverage: Column, similarity: Column, structure: Column, table: Column, blank: Column, repetition: Column, judge: Column | None = None, judge_weight: float = JUDGE_WEIGHT) -> Column:
    """Weighted scores less half the penalties, blended with a judge's score if there is one."""
    w = WEIGHTS
    base = clamp(coverage * w["text_coverage"] + similarity * w["normalized_similarity"] + structure * w["structure_retention"] + table * w["table_preservation"] - (blank + repetition) / 2)
    if judge is None:
        return base
    weight = max(0.0, min(1.0, judge_weight))
    return F.when(judge.isNull(), base).otherwise(clamp(base * (1 - weight) + judge * weight))


def severity(score: Column) -> Column:
    return F.when(score < 0.55, "high").when(score < 0.75, "medium").otherwise("low")


def penalty_severity(penalty: Column) -> Column:
    return F.when(penalty >= 0.1, "medium").otherwise("low")


def confidence(score: Column) -> Column:
    return clamp(1.0 - score)


def expected_gain(metric: Column, issue_confidence: Column, visual: Column, table: Column) -> Column:
    """From the issue if there is one, else from the table score for visual routes, else a little."""
    own = F.bround(clamp((1.0 - metric) * issue_confidence, 0.0, 0.35), 4)
    return F.when(issue_confidence.isNotNull() & metric.isNotNull(), own).when(visual, F.bround(clamp((1.0 - table) * 0.6, 0.05, 0.25), 4)).otherwise(0.05)


def cost_and_risk(visual: Column, issue_confidence: Column) -> Column:
    risk = F.when(F.coalesce(issue_confidence, F.lit(0.5)) >= 0.6, "medium").otherwise("high")
    return F.when(visual, F.struct(F.lit(1.0).alias("cost"), risk.alias("risk"))).otherwise(F.struct(F.lit(0.0).alias("cost"), F.lit("low").alias("risk")))


def optional_score(c: Column) -> Column:
    """A number from text, clamped; null if it is none."""
    return clamp(F.when(F.lower(F.trim(c.cast("string"))).isin("nan", "inf", "-inf", "infinity", "-infinity"), None).otherwise(c.cast("string").try_cast("double")))


def positive_int(c: Column, default: int = 1) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.trim(c.cast("string")).try_cast("int"), F.lit(default)))


def risk_level(risks: Column) -> Column:
    """The largest of an array of low, medium, high; low if empty."""
    return F.when(F.array_contains(risks, "high"), "high").when(F.array_contains(risks, "medium"), "medium").otherwise("low")


def gate_failures(total: Column, coverage: Column, hallucination: Column | None = None, most: float = 0.3) -> Column:
    """Names of failed checks."""
    checks = [F.when(total < MIN_TOTAL, F.lit("total_score")), F.when(coverage < MIN_COVERAGE, F.lit("text_coverage"))]
    if hallucination is not None:
        checks.append(F.when(hallucination > most, F.lit("hallucination")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
