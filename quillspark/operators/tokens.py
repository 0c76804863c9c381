"""Tokens of a document's two texts as multisets, in Arrow batches: a document stays in its row and nothing is shuffled.

Texts come in lower case from Spark.  ``\\w`` is the class of :data:`quillspark.functions.text.WORD`.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quillspark.functions import text as T

_WORD, _LINE_END = re.compile(r"\w+"), re.compile(T.LINE_END)
_LONG = LongType()
_SUMS = StructType().add("n_source", _LONG).add("n_candidate", _LONG).add("n_common", _LONG)
_LINES = ArrayType(StructType().add("line_no", _LONG).add("n_tokens", _LONG).add("n_known", _LONG))
_PAGES = ArrayType(StructType().add("page", _LONG).add("n_source", _LONG).add("n_common", _LONG))


def _common(x: Counter, y: Counter) -> int:
    if len(y) < len(x):
        x, y = y, x
    return sum(min(n, y[t]) for t, n in x.items() if t in y)


def _lines(text: str) -> list[str]:
    found = _LINE_END.split(text)
    return found if found[-1] else found[:-1]


@F.pandas_udf(_SUMS)
def _sums(sources: pd.Series, candidates: pd.Series) -> pd.DataFrame:
    out = []
    for s, c in zip(sources, candidates, strict=True):
        x, y = Counter(_WORD.findall(s or "")), Counter(_WORD.findall(c or ""))
        out.append((x.total(), y.total(), _common(x, y)))
    return pd.DataFrame(out, columns=["n_source", "n_candidate", "n_common"])


@F.pandas_udf(_LINES)
def _covered(sources: pd.Series, candidates: pd.Series) -> pd.Series:
    def one(s: str | None, c: str | None) -> list[dict[str, int]]:
        known, out = set(_WORD.findall(c or "")), []
        for k, line in enumerate(_lines(s or "")):
            if tokens := _WORD.findall(line):
                out.append({"line_no": k, "n_tokens": len(tokens), "n_known": sum(t in known for t in tokens)})
        return out

    return pd.Series([one(*x) for x in zip(sources, candidates, strict=True)], dtype=object)


def _paged(size: int):  # type: ignore[no-untyped-def]
    @F.pandas_udf(_PAGES)
    def paged(sources: pd.Series, candidates: pd.Series) -> pd.Series:
        def one(s: str | None, c: str | None) -> list[dict[str, int]]:
            a, b, out = _lines(s or ""), _lines(c or ""), []
            for k in range(0, len(a), size):
                if (x := Counter(_WORD.findall("\n".join(a[k : k + size])))) :
                    out.append({"page": k // size, "n_source": x.total(), "n_common": _common(x, Counter(_WORD.findall("\n".join(b[k : k + size]))))})
            return out

        return pd.Series([one(*x) for x in zip(sources, candidates, strict=True)], dtype=object)

    return paged


def sums(source: Column, candidate: Column) -> Column:
    """(n_source, n_candidate, n_common) tokens; of a null text none."""
    return _sums(F.lower(source), F.lower(candidate))


def by_line(source: Column, candidate: Column) -> Column:
    """(line_no, n_tokens, n_known) of the source's lines with tokens; known are those anywhere in the candidate."""
    return _covered(F.lower(source), F.lower(candidate))


def by_page(source: Column, candidate: Column, size: int = 10) -> Column:
    """(page, n_source, n_common) of pages of ``size`` lines of both texts, where the source has tokens."""
    return _paged(size)(F.lower(source), F.lower(candidate))
