"""Files to documents and candidates.

``read_sources`` scans a folder with Spark's binary reader, so any store Spark knows will do,
and bytes are parsed in Arrow batches where they are read.  ``PARSERS`` is the registry:
a parser is a function of (bytes, suffix) that returns a :class:`Parsed` or None.
Formats that need software which is not here (PDF, OCR, vision) are plug-ins: register a function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import data, filetype, html, office
from quillspark.sources import blocks as B


@dataclass
class Parsed:
    markdown: str
    plain: str
    stats: dict[str, str] = field(default_factory=dict)


Parser = Callable[[bytes, str], Parsed | None]


class Registry:
    """Parsers by name; a name is registered once."""

    def __init__(self) -> None:
        self._by_name: dict[str, Parser] = {}

    def register(self, name: str, parser: Parser) -> None:
        if name in self._by_name:
            raise ValueError(f"parser {name} is registered already")
        self._by_name[name] = parser

    def get(self, name: str) -> Parser:
        return self._by_name[name]

    def has(self, name: str) -> bool:
        return name in self._by_name

    def validate(self, names: list[str]) -> None:
        """Fails early on names that no parser has."""
        if unknown := [n for n in names if not self.has(n)]:
            raise ValueError(f"unknown parsers: {', '.join(unknown)}")

    def first(self, names: list[str], raw: bytes, suffix: str) -> tuple[str | None, Parsed | None, list[str]]:
        """(name and result of the first parser that gives one, what went wrong before)."""
        errors: list[str] = []
        for name in names:
            if not self.has(name):
                errors.append(f"{name}: not_registered")
                continue
            try:
                if (parsed := self.get(name)(raw, suffix)) is not None:
                    return name, parsed, errors
                errors.append(f"{name}: no_candidates_produced")
            except Exception as e:  # a parser's failure is the next one's turn
                errors.append(f"{name}: {type(e).__name__}: {e}")
        return None, None, errors

    def run(self, names: list[str], raw: bytes, suffix: str) -> list[tuple[str, Parsed]]:
        """Candidates of the named parsers in order."""
        return [(n, p) for n in names if (p := self.get(n)(raw, suffix)) is not None]


def _from_blocks(read: Callable[[bytes], list[B.Block]], marker: str | None = None) -> Parser:
    def parse(raw: bytes, suffix: str) -> Parsed | None:
        found = read(raw)
        stats = {f"{k}_count": str(B.count(found, k)) for k in ("heading", "table", "para", "list")}
        if marker:
            stats[f"{marker}_count"] = str(B.count(found, "marker"))
        text = B.markdown(found)
        return Parsed(text, B.plain(found), stats) if text.strip() else None

    return parse


def _csv(raw: bytes, suffix: str) -> Parsed | None:
    text = B.decode(raw)
    rows, delimiter = data.csv_rows(text) if text.strip() else ([], "")
    table = B.table_markdown(rows)
    return Parsed(table, text, {"row_count": str(len(rows)), "column_count": str(max(map(len, rows))), "delimiter": delimiter}) if table else None


def _data(raw: bytes, suffix: str) -> Parsed | None:
    text = B.decode(raw)
    try:
        value = data.load(text, suffix)
    except ValueError:
        return None
    rendered = data.data_markdown(value)
    return Parsed(rendered, data.data_text(value), {"top_level_type": type(value).__name__}) if rendered else None


def _xml(raw: bytes, suffix: str) -> Parsed | None:
    text = B.decode(raw)
    try:
        return Parsed(data.xml_markdown(text), data.xml_text(text), {"root_tag": office.local(ET.fromstring(text).tag)})
    except ET.ParseError:
        return None


def _text(raw: bytes, suffix: str) -> Parsed | None:
    text = B.decode(raw)
    return Parsed(text, text) if text.strip() else None


def default_registry() -> Registry:
    r = Registry()
    for name, parser in (
        ("docx-structured", _from_blocks(office.docx)), ("pptx-structured", _from_blocks(office.pptx, "marker")), ("xlsx-structured", _from_blocks(office.xlsx)),
        ("odt-structured", _from_blocks(office.odt)), ("html-structured", _from_blocks(lambda raw: html.blocks(B.decode(raw)))), ("csv-structured", _csv),
        ("data-structured", _data), ("xml-structured", _xml), ("text-fallback", _text), ("source-text", _text),
    ):
        r.register(name, parser)
    return r


SCHEMA = "parser_name string, content string, extracted_text string, stats map<string,string>, error string"


def parse_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """path, suffix, media_type, size_bytes and the parser's result; errors are values, not failures.

    files: path, content (bytes).
    """
    known = registry or default_registry()

    def one(raw: bytes, suffix: str, name: str) -> tuple:
        try:
            parsed = known.get(name)(raw, suffix) if known.has(name) else None
            fallback = None if parsed or suffix not in filetype.TEXT_SUFFIXES else B.decode(raw)
            return (name, parsed.markdown, parsed.plain, parsed.stats, None) if parsed else (name, None, fallback, {}, None)
        except Exception as e:  # a broken file is a row with its error
            return name, None, None, {}, f"{type(e).__name__}: {e}"

    @F.pandas_udf(SCHEMA)
    def run(raws: pd.Series, suffixes: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(bytes(r or b""), s, n) for r, s, n in zip(raws, suffixes, names, strict=True)], columns=["parser_name", "content", "extracted_text", "stats", "error"])

    path = F.col("path")
    typed = files.select("path", "content", filetype.suffix(path).alias("suffix"), filetype.media_type(path).alias("media_type"), F.length("content").cast("long").alias("size_bytes"))
    parsed = typed.withColumn("p", run("content", "suffix", filetype.base_parser(F.col("suffix"), F.col("media_type"))))
    return parsed.select("path", "suffix", "media_type", "size_bytes", "p.*")


def read_sources(spark: SparkSession, folder: str, glob: str = "*", registry: Registry | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return parse_files(files.select("path", "content"), registry)


def html_blocks(pages: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """keys, block_no, kind, level, text for each block of HTML in a column."""
    inner = "array<struct<block_no:int,kind:string,level:int,text:string>>"

    @F.pandas_udf(inner)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(i, b.kind, b.level, b.text or "\n".join(b.plain())) for i, b in enumerate(html.blocks(t or ""))])

    return pages.select(*keys, F.explode(run(F.col(column))).alias("b")).select(*keys, "b.*")


def rendered(kind: str):
    """Column function: HTML to ``markdown`` or ``plain``; JSON to ``json_markdown`` or ``json_text``."""
    makers: dict[str, Callable[[str], str]] = {
        "markdown": lambda t: B.markdown(html.blocks(t)), "plain": lambda t: B.plain(html.blocks(t)),
        "json_markdown": lambda t: data.data_markdown(data.load(t, ".json")), "json_text": lambda t: data.data_text(data.load(t, ".json")),
        "xml_markdown": data.xml_markdown, "xml_text": data.xml_text,
    }
    make = makers[kind]

    def safe(t: str | None) -> str | None:
        try:
            return None if t is None else make(t)
        except (ValueError, ET.ParseError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(safe)

    return run


def nfc(column):
    """Normalised text, NFC included; ASCII needs no Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else B.normalize(t))

    return F.when(column.rlike(r"^[\x00-\x7F]*$"), column).otherwise(run(column))


def merge_stats(batches: Iterator[dict]) -> dict[str, int]:
    """Summed counters of several files."""
    total: dict[str, int] = {}
    for b in batches:
        for k, v in b.items():
            if str(v).isdigit():
                total[k] = total.get(k, 0) + int(v)
    return total


CHAIN = "parser_name string, content string, extracted_text string, stats map<string,string>, errors array<string>"


def parse_with_fallback(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Like :func:`parse_files`, trying the parsers of the fallback chain in order; errors lists what failed before.

    files: path, content (bytes).
    """
    from quillspark.plans.planner import fallback_chain

    known = registry or default_registry()

    def one(raw: bytes, suffix: str, names: list[str]) -> tuple:
        name, parsed, errors = known.first(list(names), raw, suffix)
        return (name, parsed.markdown, parsed.plain, parsed.stats, errors) if parsed else (None, None, None, {}, errors)

    @F.pandas_udf(CHAIN)
    def run(raws: pd.Series, suffixes: pd.Series, chains: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(bytes(r or b""), s, c) for r, s, c in zip(raws, suffixes, chains, strict=True)], columns=[c.split()[0] for c in CHAIN.split(", ")])

    path = F.col("path")
    typed = files.select("path", "content", filetype.suffix(path).alias("suffix"), filetype.media_type(path).alias("media_type"), F.length("content").cast("long").alias("size_bytes"))
    parsed = typed.withColumn("p", run("content", "suffix", fallback_chain(F.col("suffix"), F.col("media_type"))))
    return parsed.select("path", "suffix", "media_type", "size_bytes", "p.*")


def read_with_fallback(spark: SparkSession, folder: str, glob: str = "*", registry: Registry | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return parse_with_fallback(files.select("path", "content"), registry)
