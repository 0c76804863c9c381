"""Finding a table by its place and putting another in its stead; tables from several candidates fused.

Places are a table's number in the text, its number on a page, or a label above it.  Patches are
order-dependent (a patch moves what follows), so they run per document in Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as T
from quillspark.operators import metrics, recovery
from quillspark.operators import tables as B
from quillspark.operators.folds import tables as strict_tables

_NUMBER, _HEADING = re.compile(r"\d+(?:\.\d+)?"), re.compile(r"\s*#+\s")
_CAPTION = re.compile(r"\s*표\s*\d+(?:\.\d+)?-\d+")
_MARKER = re.compile(r"<!-- page (\d+) -->$")
#: Fixed: a pooled table must reach the floor and beat the current one by the margin; the current one counts if it matches.
FLOOR, MARGIN, MATCH, ABOVE = 0.5, 0.1, 0.2, 7


def plain_row(line: str) -> bool:
    """A row that lost its bars: columns two spaces apart, or two numbers."""
    s = line.strip()
    if not s or s.startswith(("<!--", "|")) or _HEADING.match(s) or re.match(r"</?table", s, re.I):
        return False
    return "  " in line or len(_NUMBER.findall(s)) > 1


def plain_header(line: str) -> bool:
    """Four to twelve short words without sentence marks."""
    s = line.strip()
    words = s.split()
    return bool(s) and not s.startswith(("<!--", "|")) and not _HEADING.match(s) and not _CAPTION.match(s) and not re.search(r"[.!?:;]", s) and 4 <= len(words) <= 12 and max(map(len, words)) <= 8


def block_bounds(lines: list[str]) -> list[tuple[int, int]]:
    """[start, end) of Markdown, HTML and plain tables in order."""
    found = [(start, start + len(block)) for start, block in B.table_lines(lines)]
    taken = {i for a, b in found for i in range(a, b)}
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and j not in taken and plain_row(lines[j]):
            j += 1
        if j - i > 1:
            found.append((i - 1 if i and i - 1 not in taken and plain_header(lines[i - 1]) else i, j))
        i = max(j, i + 1)
    return sorted(found)


def pages(lines: list[str]) -> dict[int, tuple[int, int]]:
    """Page number to its lines [start, end); a text without markers is page 1."""
    marks = [(i, int(m[1])) for i, x in enumerate(lines) if (m := _MARKER.match(x.strip()))]
    ends = [i for i, _ in marks[1:]] + [len(lines)]
    return {n: (i + 1, e) for (i, n), e in zip(marks, ends, strict=True)} if marks else {1: (0, len(lines))}


def locate(lines: list[str], number: int | None = None, page: int | None = None, label: str | None = None) -> tuple[int, int] | None:
    """The table with this number (from 0) in the text or on the page, else the first within reach below the label."""
    found = block_bounds(lines)
    if page is not None:
        a, b = pages(lines).get(page, (0, 0))
        found = [x for x in found if a <= x[0] < b]
    if label:
        flat = "".join(label.split())
        at = [i for i, x in enumerate(lines) if flat in "".join(x.split())]
        near = [next((x for x in found if i < x[0] <= i + 5), None) for i in at]
        return next((x for x in near if x), None)
    return found[number or 0] if (number or 0) < len(found) else None


def replace(lines: list[str], new: list[str], **place) -> list[str]:
    """The text with the table at the place replaced; unchanged if there is none."""
    at = locate(lines, **place)
    return lines[: at[0]] + new + lines[at[1] :] if at else lines


def insert(lines: list[str], new: list[str], label: str | None = None, page: int | None = None) -> list[str]:
    """Behind the line of the label, else behind the page's marker, else nowhere."""
    flat = "".join((label or "").split())
    at = next((i for i, x in enumerate(lines) if flat and flat in "".join(x.split())), None)
    if at is None and page is not None:
        at = next((i for i, x in enumerate(lines) if (m := _MARKER.match(x.strip())) and int(m[1]) == page), None)
    return lines if at is None else [*lines[: at + 1], "", *new, "", *lines[at + 1 :]]


def patch(lines: list[str], new: list[str], **place) -> list[str]:
    """Replace, else insert."""
    out = replace(lines, new, **place)
    return out if out != lines else insert(lines, new, place.get("label"), place.get("page"))


def fuse(references: list[B.Grid], current: list[str], pool: list[list[str]]) -> list[str]:
    """For each reference grid the best table: the current one, or a pooled one that is clearly better."""
    offered = [(t.rows, g, lines, t.start) for lines in pool for t in strict_tables(lines) if len(g := B.grid(t.rows)) > 1]
    used: set[int] = set()
    for reference in references:
        here = [(B.best_offset(reference, g), t) for t in strict_tables(current) if len(g := B.grid(t.rows)) > 1]
        best, own = max(here, key=lambda x: x[0], default=(0.0, None))
        other, k = max(((B.best_offset(reference, g), k) for k, (_, g, _, _) in enumerate(offered) if k not in used), default=(0.0, -1))
        if k < 0 or other < FLOOR or (own is not None and best >= MATCH and other < best + MARGIN):
            continue
        used.add(k)
        rows, _, lines, start = offered[k]
        if own is not None and best >= MATCH:
            current = current[: own.start] + rows + current[own.end :]
        else:
            current = _insert_like(current, rows, [x for x in lines[max(0, start - ABOVE) : start] if x.strip()])
    return current


def _insert_like(lines: list[str], rows: list[str], above: list[str]) -> list[str]:
    """Behind the nearest line that also stands above the table where it comes from; else at the end."""
    where = {" ".join(x.lower().split()): i for i, x in enumerate(lines)}
    for x in reversed(above):
        if (i := where.get(" ".join(x.lower().split()))) is not None:
            return [*lines[: i + 1], "", *rows, "", *lines[i + 1 :]]
    return [*lines, "", *rows]


@F.pandas_udf(StringType())
def _fused(references: pd.Series, currents: pd.Series, pools: pd.Series) -> pd.Series:
    def one(r: str | None, c: str | None, p: str | None) -> str | None:
        lines = (c or "").splitlines()
        new = fuse(B.grids_of(r), lines, [(x or "").splitlines() for x in json.loads(p)]) if r and p else lines
        return c if new == lines else "\n".join(new)

    return pd.Series([one(*x) for x in zip(references, currents, pools, strict=True)])


def fused(references, current, pool):  # type: ignore[no-untyped-def]
    """references: array of grids; pool: array of other candidates' texts.  Without references or a change the text stays as it is."""
    return _fused(B.grids_json(references), current, B.grids_json(pool))


@F.pandas_udf(StringType())
def replaced(texts: pd.Series, numbers: pd.Series, tables: pd.Series) -> pd.Series:
    """Texts with the table of a number replaced."""
    return pd.Series(["\n".join(replace((t or "").splitlines(), (n or "").splitlines(), number=int(k))) for t, k, n in zip(texts, numbers, tables, strict=True)])


def grounding(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Table regions: keys, block_no, start, end, page, page_index (from 0 on its page)."""
    lines = metrics.exploded(df, keys, text)
    blocks = metrics.table_blocks(df, keys, text)
    page_of = recovery.page_ids(lines, keys).select(*keys, F.col("line_no").alias("start"), "page")
    w = Window.partitionBy(*keys, "page").orderBy("start")
    return blocks.join(page_of, [*keys, "start"]).select(*keys, "block_no", "start", "end", "page", (F.row_number().over(w) - 1).alias("page_index"))


def rows_html(rows: Column) -> Column:
    """Rows of cells as an HTML table."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), safe(T.collapse(c)), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))
