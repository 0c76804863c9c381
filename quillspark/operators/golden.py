"""Agreement of metrics with human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_rating(ratings: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    return ratings.groupBy(field).agg(F.avg(value).alias("mean_rating"), F.count(value).alias("n"))


def rater_agreement(ratings: DataFrame, document: str = "document", field: str = "field", value: str = "value") -> DataFrame:
    """Over (document, field) with two raters or more: share in exact and in within-one agreement."""
    pairs = ratings.groupBy(document, field).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.count(value).alias("n")).filter("n >= 2")
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg((F.col("hi") == F.col("lo")).cast("double")).alias("exact"), F.avg((F.col("hi") - F.col("lo") <= 1).cast("double")).alias("within_one"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ties share the mean of their ranks: from counts of distinct values, so ranking sorts values, not rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(column, (below + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(ranks, column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; 0 if either side does not vary."""
    pairs = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(pairs, a, "ra"), b, "rb")
    n, sa, sb = F.count("*"), F.sum("ra"), F.sum("rb")
    cov = n * F.sum(F.col("ra") * F.col("rb")) - sa * sb
    va, vb = n * F.sum(F.col("ra") * F.col("ra")) - sa * sa, n * F.sum(F.col("rb") * F.col("rb")) - sb * sb
    sums = ranked.agg(n.alias("n"), cov.alias("cov"), va.alias("va"), vb.alias("vb"))
    return sums.select("n", F.when((F.col("va") <= 0) | (F.col("vb") <= 0), 0.0).otherwise(F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("rho"))


def best_engine(scores: DataFrame, document: str = "document", engine: str = "engine", total: str = "total_score") -> DataFrame:
    """The engine with the largest total per document; ties go to the first name."""
    top = scores.groupBy(document).agg(F.min_by(F.struct(engine, total), F.struct(-F.col(total), F.col(engine))).alias("t"))
    return top.select(document, F.col(f"t.{engine}").alias(engine), F.col(f"t.{total}").alias(total))
