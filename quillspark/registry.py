"""All registered queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import queries as q
from quillspark.plans import rule_queries, visual_queries  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, hygiene, total score and failed checks of damaged documents."""
    return q.aggregate_score(spark, sf_dir)
