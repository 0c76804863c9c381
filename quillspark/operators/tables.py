"""Tables of one document compared with another's, and HTML tables as Markdown.

Greedy one-to-one matches and cell similarities depend on order within a document, so a
document's pair of texts goes through one Arrow function; documents stay independent.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from itertools import zip_longest

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quillspark.functions.labels import EVALUATED, GENERIC_TOKENS
from quillspark.operators.folds import tables
from quillspark.operators.matching import ratio

_WORD, _NUMBER, _LABEL = re.compile(r"\w+"), re.compile(r"\d+(?:\.\d+)?"), re.compile(EVALUATED)
# Fixed: lines below a label, characters behind it, and row offsets that are tried.
_REACH, _CONTEXT, _OFFSETS = 12, 240, 400
Grid = list[list[str]]


# HTML tables


@dataclass
class Cell:
    text: str
    wide: int
    tall: int
    head: bool


class _Tables(HTMLParser):
    """Rows of cells with their spans."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[Cell]] = []
        self._cell: Cell | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            size = lambda n: int(v) if (v := dict(attrs).get(n) or "").isdigit() and int(v) > 0 else 1
            self._cell = Cell("", size("colspan"), size("rowspan"), tag == "th")
            (self.rows or self.rows.append([]) or self.rows)[-1].append(self._cell)
        elif tag == "br" and self._cell:
            self._cell.text += " "

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._cell = None

    def handle_data(self, data: str) -> None:
        if self._cell:
            self._cell.text += data


def spanned(rows: list[list[Cell]]) -> Grid:
    """A rectangle: tall cells repeat downwards, wide ones leave blanks to their right."""
    held: dict[tuple[int, int], str] = {}
    out: Grid = []
    for i, row in enumerate(rows):
        line: list[str] = []
        for cell in row:
            while (i, len(line)) in held:
                line.append(held.pop((i, len(line))))
            text = " ".join(cell.text.split())
            for k in range(cell.wide):
                for below in range(1, cell.tall):
                    held[i + below, len(line)] = text
                line.append(text if k == 0 else "")
        while (i, len(line)) in held:
            line.append(held.pop((i, len(line))))
        out.append(line)
    wide = max(map(len, out), default=0)
    return [r + [""] * (wide - len(r)) for r in out]


def _filled(row: list[str]) -> list[str]:
    out: list[str] = []
    for c in row:
        out.append(c or (out[-1] if out else ""))
    return out


def html_table(markup: str) -> str:
    """Markdown of an HTML table; header rows collapse to ``a / b``; blank columns and rows go."""
    p = _Tables()
    p.feed(markup)
    rows = [r for r in p.rows if r]
    n_head = 0
    while n_head < len(rows) and all(c.head for c in rows[n_head]):
        n_head += 1
    parts = (spanned(rows[:n_head]), spanned(rows[n_head:])) if n_head else (spanned(rows)[:1], spanned(rows)[1:])
    wide = max((len(r) for part in parts for r in part), default=0)
    head, body = ([r + [""] * (wide - len(r)) for r in part] for part in parts)
    used = [j for j in range(wide) if any(r[j] for r in head + body)]
    if not used or not head:
        return ""
    columns = list(zip(*([_filled([r[j] for j in used]) for r in head]), strict=True))
    top = [" / ".join(x for k, x in enumerate(c) if x and (k == 0 or x != c[k - 1])) for c in columns]
    shown = [top, ["---"] * len(used), *([r[j] for j in used] for r in body if any(r))]
    return "\n".join(f"| {' | '.join(c.replace('|', chr(92) + '|') for c in r)} |" for r in shown)


@F.pandas_udf(StringType())
def html_tables_as_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if not t else re.sub(r"<table\b.*?</table>", lambda m: html_table(m[0]), t, flags=re.I | re.S))


# Grids


def grid(rows: list[str]) -> Grid:
    out = []
    for row in rows:
        cells = [" ".join(c.split()).lower() for c in row.strip().split("|")[1:-1]]
        if cells and not all(set(c) <= set("-: ") for c in cells) and any(cells):
            out.append(cells)
    return out


def _short_matched(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int) -> int:
    """Characters in the blocks of difflib's matcher for texts without frequent characters."""
    for n in range(min(ahi - alo, bhi - blo), 0, -1):
        for i in range(alo, ahi - n + 1):
            j = b.find(a[i : i + n], blo, bhi)
            if j >= 0:
                return n + _short_matched(a, alo, i, b, blo, j) + _short_matched(a, i + n, ahi, b, j + n, bhi)
    return 0


@lru_cache(1 << 16)
def _cell_ratio(a: str, b: str) -> float:
    if len(a) + len(b) <= 64:
        return 2.0 * _short_matched(a, 0, len(a), b, 0, len(b)) / (len(a) + len(b))
    return ratio(a, b)


def cell_similarity(a: str, b: str) -> float:
    return 1.0 if a == b else 0.0 if not a or not b else _cell_ratio(a, b)


def teds_lite(a: Grid, b: Grid) -> float:
    """Mean cell similarity over rows and columns aligned by place."""
    pairs = [p for x, y in zip_longest(a, b, fillvalue=[]) for p in zip_longest(x, y, fillvalue="")] if a and b else []
    return sum(1.0 if x == y else cell_similarity(x, y) for x, y in pairs) / len(pairs) if pairs else 0.0


def best_offset(reference: Grid, candidate: Grid) -> float:
    """The reference against every window of the candidate that starts at a row."""
    return max((teds_lite(reference, candidate[k : k + len(reference)]) for k in range(min(len(candidate), _OFFSETS + 1))), default=0.0) if reference else 0.0


def table_cell_similarity(references: list[Grid], candidate: str) -> float | None:
    """Mean of each reference's best table; none without references, 0 without tables."""
    found = [g for t in tables(candidate.splitlines()) if len(g := grid(t.rows)) > 1]
    return sum(max((best_offset(r, g) for g in found), default=0.0) for r in references) / len(references) if references else None


def grids_json(references):  # type: ignore[no-untyped-def]
    """Grids as JSON: nested arrays that are null do not pass into pandas safely."""
    return F.to_json(F.col(references) if isinstance(references, str) else references)


def grids_of(text: str) -> list[Grid]:
    return [[["" if c is None else str(c) for c in row] for row in g] for g in json.loads(text)]


@F.pandas_udf(DoubleType())
def _grids_similarity(references: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else table_cell_similarity(grids_of(r), c or "") for r, c in zip(references, candidates, strict=True)], dtype="float64")


def grids_similarity(references, candidate):  # type: ignore[no-untyped-def]
    """references: array<array<array<string>>>; candidate: Markdown.  Null without references."""
    return _grids_similarity(grids_json(references), candidate)


# Tables of flattened sources


def table_lines(lines: list[str]) -> list[tuple[int, list[str]]]:
    """(start, lines) of Markdown and HTML tables."""
    row = lambda s: (s.count("|") > 1 and "|" in (s[:1], s[-1:])) or s.lower().startswith("<table")
    out, i = [], 0
    while i < len(lines):
        s = lines[i].strip()
        if not row(s):
            i += 1
            continue
        j = i + 1
        if s.lower().startswith("<table"):
            while j < len(lines) and "</table>" not in lines[j - 1].lower():
                j += 1
        else:
            while j < len(lines) and row(lines[j].strip()):
                j += 1
        out.append((i, lines[i:j]))
        i = j
    return out


def _tokens(text: str) -> set[str]:
    return {t for t in _WORD.findall(text.lower()) if not t.isdigit() and t not in GENERIC_TOKENS}


def _share(want: set[str], have: set[str]) -> list[float]:
    return [len(want & have) / len(want)] if want else []


def labelled_match(context: str, block: list[str]) -> float:
    """Whether header, body and numbers of a table meet the source's context; HTML: shares of them."""
    if len(block) < 2:
        return 0.0
    text = "\n".join(block)
    words, numbers = _tokens(context), set(_NUMBER.findall(context))
    if "<table" in text.lower():
        scores = [1.0, *_share(words, _tokens(text)), *_share(numbers, set(_NUMBER.findall(text)))]
        return sum(scores) / len(scores)
    hits = (words & _tokens(block[0]), words & _tokens("\n".join(block[2:])), numbers & set(_NUMBER.findall(text)))
    return (1 + sum(map(bool, hits))) / 4


def unlabelled_match(context: str, block: list[str]) -> float:
    text = "\n".join(block)
    scores = _share(_tokens(context), _tokens(text)) + _share(set(_NUMBER.findall(context)), set(_NUMBER.findall(text)))
    return sum(scores) / len(scores) if scores else float(len(block) > 1)


def numeric_blocks(text: str) -> list[str]:
    """Runs of lines with numbers, with a plain line above as their header."""
    out: list[list[str]] = []
    above, inside = None, False
    for line in text.splitlines():
        n, words = len(_NUMBER.findall(line)), len(_WORD.findall(line))
        if n > 1 or (n and words > 3):
            if not inside:
                out.append([above] if above and not _NUMBER.search(above) and len(_WORD.findall(above)) > 1 else [])
            out[-1].append(line)
            inside = True
        else:
            inside, above = False, line if line.strip() else None
    return ["\n".join(b) for b in out]


def _greedy(wanted: list[tuple[str, list[int]]], found: list[tuple[int, list[str]]], match) -> float:
    """Sum of best matches in order; each table is used once; the first of equals wins."""
    used: set[int] = set()
    total = 0.0
    for context, allowed in wanted:
        scored = [(match(context, found[k][1]), -k) for k in allowed if k not in used]
        best, k = max(scored, default=(0.0, 0))
        if best > 0:
            used.add(-k)
            total += best
    return total


def _counted(e: int, a: int) -> float:
    return max(0.0, 1 - abs(e - a) / e) if e else float(a == 0)


def table_match(source: str, candidate: str) -> float:
    """Labels kept and the tables behind them; without labels, numeric blocks against tables; else table lines."""
    lines = candidate.splitlines()
    found = table_lines(lines)
    labels = list(dict.fromkeys(_LABEL.findall(source)))
    if labels:
        wanted, kept = [], 0
        for label in labels:
            pattern = re.compile(rf"(?:표|表)\s*(?:<\s*)?{re.escape(label)}(?![\d.-])")
            at = next((i for i, x in enumerate(lines) if pattern.search(x)), None)
            m = pattern.search(source)
            if at is not None:
                kept += 1
                wanted.append((source[m.end() : m.end() + _CONTEXT] if m else "", [k for k, (start, _) in enumerate(found) if at < start <= at + _REACH]))
        return (kept + _greedy(wanted, found, labelled_match)) / (2 * len(labels))
    blocks = numeric_blocks(source)
    if not blocks:
        own = [x for _, b in table_lines(source.splitlines()) for x in b]
        return _counted(len(own), sum(len(b) for _, b in found))
    score = _counted(len(blocks), len(found))
    return (score + _greedy([(b, list(range(len(found)))) for b in blocks], found, unlabelled_match) / len(blocks)) / 2 if found else score / 2


@F.pandas_udf(DoubleType())
def pdf_table_preservation(sources: pd.Series, candidates: pd.Series) -> pd.Series:
    """Null where both are null."""
    return pd.Series([None if s is None and c is None else table_match(s or "", c or "") for s, c in zip(sources, candidates, strict=True)], dtype="float64")


def grounding(reference: str, markup: str) -> float | None:
    """Share of a recovered table's cells that the reference text holds; none for short references."""
    flat = "".join(reference.split())
    raw = re.findall(r">([^<>]+)<", markup) if "<table" in markup.lower() else [c for x in markup.splitlines() if x.strip().startswith("|") for c in x.strip().split("|")[1:-1]]
    cells = [c for c in ("".join(x.split()) for x in raw) if len(c) > 1 and set(c) - set("-:")]
    return None if len(flat) < 30 or not cells else sum(c in flat for c in cells) / len(cells)


@F.pandas_udf(DoubleType())
def grounding_ratio(references: pd.Series, markups: pd.Series) -> pd.Series:
    return pd.Series([grounding(r or "", m or "") for r, m in zip(references, markups, strict=True)], dtype="float64")
