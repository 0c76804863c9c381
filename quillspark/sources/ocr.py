"""Reading results of OCR engines: JSON of many shapes to text with page markers, and its figures.

A result is a tree of unknown depth, so a document's JSON is walked in Python, batch by batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from quillspark.sources import blocks as B
from quillspark.sources import html

# Fixed: where page lists, texts and kinds stand.
PAGE_KEYS, TEXT_KEYS, KIND_KEYS = ("pages", "page_results", "results"), ("text", "content", "markdown"), ("type", "label", "block_type", "layout_label")

FIGURES = StructType().add("text", StringType()).add("n_pages", IntegerType()).add("n_blocks", IntegerType()).add("n_table_blocks", IntegerType()).add("mean_confidence", DoubleType())


def walk(value: object) -> Iterator[dict]:
    """All objects of a tree, each before its parts."""
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    for part in value if isinstance(value, list) else ():
        yield from walk(part)


def pages(value: object) -> list:
    """The list of pages, wherever it stands."""
    if isinstance(value, list):
        return value
    if not isinstance(value, dict) or not value:
        return []
    named = next((value[k] for k in PAGE_KEYS if isinstance(value.get(k), list)), None)
    if named is not None:
        return named
    parts = list(value.values())
    if all(isinstance(p, dict) for p in parts):
        return parts
    return [x for p in parts for x in p] if all(isinstance(p, list) for p in parts) else []


def _said(item: dict, keys: tuple[str, ...]) -> str | None:
    return next((item[k] for k in keys if isinstance(item.get(k), str) and item[k].strip()), None)


def texts(value: object) -> list[str]:
    """Texts in order, HTML before plain ones, without one that repeats the last."""
    out: list[str] = []
    for item in walk(value):
        if markup := _said(item, ("html",)):
            said = B.plain(html.blocks(markup)).strip()
        else:
            said = re.sub(r"\n{3,}", "\n\n", B.normalize(_said(item, TEXT_KEYS) or "")).strip()
        if said and out[-1:] != [said]:
            out.append(said)
    return out


def result_text(value: object) -> str:
    """Pages under their markers; without pages, all texts."""
    bodies = ((k, "\n".join(texts(p)).strip()) for k, p in enumerate(pages(value), 1))
    marked = [f"<!-- page {k} -->\n\n{body}" for k, body in bodies if body]
    return "\n\n".join(marked) if marked else "\n".join(texts(value))


def figures(value: object) -> tuple[int | None, int, int, float | None]:
    """Pages, text blocks, table blocks, mean confidence."""
    items = [x for x in walk(value) if _said(x, ("html", "text", "content"))]
    table = lambda x: "table" in str(next((x[k] for k in KIND_KEYS if x.get(k)), "")).lower() or "<table" in str(x.get("html") or "").lower()
    sure = [float(c) for x in walk(value) if isinstance(c := x.get("confidence") or x.get("score"), int | float)]
    return len(pages(value)) or None, len(items), sum(map(table, items)), sum(sure) / len(sure) if sure else None


@F.pandas_udf(FIGURES)
def read_result(results: pd.Series) -> pd.DataFrame:
    """Text and figures of results; nulls for one that is no JSON."""

    def one(raw: str | None) -> tuple:
        try:
            value = json.loads(raw or "")
        except ValueError:
            return None, None, None, None, None
        return result_text(value), *figures(value)

    out = pd.DataFrame([one(r) for r in results], columns=["text", "n_pages", "n_blocks", "n_table_blocks", "mean_confidence"])
    return out.astype({c: "Int32" for c in ("n_pages", "n_blocks", "n_table_blocks")})
