"""Sequence similarity: the matching-block ratio of two texts, in Arrow batches.

Catalyst has no equivalent (edit distance differs), so these are Pandas functions;
texts that are equal after normalisation, and empty ones, never reach Python.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions import text as T
from quillspark.operators.matching import ratio

#: Word streams longer than this are compared by token F1.
LONG = 20_000


def _f1(a: str, b: str) -> float:
    x, y = Counter(a.split(" ")), Counter(b.split(" "))
    return 2 * (x & y).total() / (x.total() + y.total())


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _stream_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    one = lambda x, y: _f1(x, y) if max(len(x), len(y)) > LONG else ratio(x, y)
    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def text_similarity(source: Column, candidate: Column) -> Column:
    """On normalised texts; 1 if both are empty.

    The matcher leaves out characters that make up over 1 % of a text of 200 or more, so that what it compares
    in long texts is little.
    """
    a, b = T.normalize(F.coalesce(source, F.lit(""))), T.normalize(F.coalesce(candidate, F.lit("")))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(_ratio(a, b))


def content_similarity(source: Column, candidate: Column) -> Column:
    """On word streams, so that markup does not count; of long ones the F1 of their tokens; null if a text is null."""
    a, b = (F.array_join(T.words(x), " ") for x in (source, candidate))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(_stream_ratio(a, b))


def cell_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(_ratio(a, b))
