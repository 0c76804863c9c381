"""Text and line expressions.

White space and word classes are the Unicode ones (``(?U)``), as documents mix scripts.
A line table row and an element of a line array are judged by the same functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the Markdown dialect.
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
LIST_ITEM = r"^([-*+]|[0-9]+\.)\s+"
PAREN_ITEM = r"^\([0-9]+\)\s+"
SECTION = r"^\s*(?:제\s*[0-9]+\s*장|[0-9]+(?:\.[0-9]+)*\.|[가-힣A-Z]\.)\s+"
CAPTION = r"(?i)^\s*(?:표|그림|table|figure)\s*[0-9]"
PAGE_MARKER = r"^<!-- page ([0-9]+) -->$"
PAGE_FOOTER = r"^-?\s*[0-9]+\s*-?$"
HEADING = r"^\s*#+\s*(.+?)\s*$"
IMAGE = r"!\[[^\]]*\]\((?:<[^>]+>|[^)]+)\)"
KEY_VALUE = r"^\s*([^:：|]{1,80}?)(?:[:：]|\s{2,})(.+?)\s*$"
CHAPTER_CUE = r"제\s*[0-9]+\s*장"
SECTION_CUE = r"(?<![0-9|])((?:[1-9]|1[0-9]|20)\.[0-9]{1,2})(?=\s*[A-Za-z가-힣])"
SUBSECTION_CUE = r"(?<![\p{L}\p{N}_])([가-하])\.\s*"
KOREAN_TERMINAL = r"(?:다|요|음|함|됨|임|것)\s*$"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also inside lambdas of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The characters of ``(?U)\\s``.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def any_of(*patterns: str) -> str:
    """One pattern for all of them."""
    return "|".join(f"(?:{p})" for p in patterns)


def collapse(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Collapsed and lower-cased: how lines and texts are compared."""
    return F.lower(collapse(c))


def compact(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def normalize_markup(c: Column) -> Column:
    """No byte order mark, plain spaces.  (NFC needs :func:`quillspark.sources.text.nfc`.)"""
    return F.replace(F.replace(c, F.lit("\ufeff"), F.lit("")), F.lit("\u00a0"), F.lit(" "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), 0)


def n_fields(c: Column) -> Column:
    """Fields between white space."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def excerpt(c: Column, limit: int = 240, dots: bool = True) -> Column:
    """Collapsed and cut to ``limit`` characters; null if blank."""
    flat = collapse(c)
    cut = F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("...")) if dots else F.left(flat, F.lit(limit))
    return F.when(flat == "", None).when(F.length(flat) > limit, cut).otherwise(flat)


def lines(c: Column) -> Column:
    """Lines without their ends; no last empty line; empty text has none."""
    return let(F.split(c, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def join_lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def blank(c: Column) -> Column:
    return strip(c) == ""


# Six predicates for table rows coexist; callers keep their own.


# ``_x`` judges a stripped line, ``x`` strips first and once.


def _table_line(s: Column) -> Column:
    return _markdown_row(s) | F.lower(F.left(s, F.lit(6))).startswith("<table")


def _markdown_row(s: Column) -> Column:
    return (s.startswith("|") | s.endswith("|")) & (count(s, "|") >= 2)


def table_line(c: Column) -> Column:
    """Two bars or more and one at either end, or an HTML table."""
    return let(strip(c), _table_line)


def strict_row(c: Column) -> Column:
    """A bar at both ends."""
    return let(strip(c), lambda s: s.startswith("|") & s.endswith("|"))


def full_row(c: Column) -> Column:
    """A bar at both ends and two at least."""
    return let(strip(c), lambda s: s.startswith("|") & s.endswith("|") & (count(s, "|") >= 2))


def open_row(c: Column) -> Column:
    """A bar in front."""
    return strip(c).startswith("|")


def markdown_row(c: Column) -> Column:
    """Two bars or more and one at either end; no HTML."""
    return let(strip(c), _markdown_row)


def any_bar(c: Column) -> Column:
    return c.contains("|")


def bare(c: Column) -> Column:
    """A row without the bar at either end."""
    return F.regexp_replace(strip(c), r"^\||\|$", "")


def cells(c: Column) -> Column:
    """Trimmed cells of a row."""
    return F.transform(F.split(bare(c), r"\|", -1), strip)


def separator_line(c: Column) -> Column:
    """A table row whose cells are non-empty and made of dashes and colons."""
    return table_line(c) & F.forall(cells(c), lambda x: x.rlike(r"^[:-]+$"))


def separator_cells(cs: Column, empty: bool = False) -> Column:
    """All cells of dashes and colons; ``empty``: empty ones too."""
    return F.forall(cs, lambda x: x.rlike(r"^[:-]*$" if empty else r"^[:-]+$"))


def _kind(s: Column) -> Column:
    return F.when(s == "", None).when(s.startswith("#"), "heading").when(s.rlike(LIST_ITEM), "list").when(_table_line(s), "table")


def kind(c: Column) -> Column:
    """heading, list, table or null, in this precedence."""
    return let(strip(c), _kind)


def _structured_source(s: Column) -> Column:
    return (s != "") & (s.rlike(any_of(HEADING, LIST_ITEM, SECTION, CAPTION)) | (s.endswith(":") & (F.length(s) <= 80)))


def structured_source(c: Column) -> Column:
    """Heading, list item, section, caption, or a short line that ends with a colon."""
    return let(strip(c), _structured_source)


def _structural(s: Column) -> Column:
    return (s != "") & (s.rlike(any_of("^#", LIST_ITEM, PAREN_ITEM, SECTION, CAPTION, PAGE_MARKER, PAGE_FOOTER)) | _markdown_row(s))


def structural(c: Column) -> Column:
    """Lines that are never part of a running paragraph."""
    return let(strip(c), _structural)


def boundary(c: Column) -> Column:
    """Short plain lines, such as running headers."""
    return let(strip(c), lambda s: (s != "") & (F.length(s) <= 80) & ~_structural(s) & (n_fields(s) <= 8))


def boundary_heading(c: Column) -> Column:
    return strip(c).rlike(any_of(SECTION, LIST_ITEM, CAPTION))


def _corrupted_row(s: Column) -> Column:
    return s.contains("|") & (s.rlike(IMAGE) | ((count(s, "|") >= 2) & ~(s.startswith("|") | s.endswith("|"))))


def corrupted_row(c: Column) -> Column:
    """A bar beside an image, or bars inside only."""
    return let(strip(c), _corrupted_row)


def key_value(c: Column) -> Column:
    """``label: value`` or two columns of text, without bars and without long prose."""
    label, value = strip(F.regexp_extract(c, KEY_VALUE, 1)), strip(F.regexp_extract(c, KEY_VALUE, 2))
    return ~c.contains("|") & c.rlike(KEY_VALUE) & (label != "") & (value != "") & ((n_fields(value) <= 12) | value.rlike("[0-9]"))


def numeric_row(c: Column) -> Column:
    """Two numbers, or one and four words: a table row that lost its bars."""
    n = F.size(numbers(c))
    return ~blank(c) & ((n >= 2) | ((n >= 1) & (F.size(words(c)) >= 4)))


def joints(c: Column) -> Column:
    """How a line may join its neighbours: what :func:`join` needs of it."""
    return let(strip(c), lambda s: let((s != "") & ~_structural(s), lambda plain: F.struct(
        (plain & ~s.rlike(r"[.!?:;]$")).alias("open"), plain.alias("plain"), (s.endswith("-") & ~s.rlike(PAGE_FOOTER)).alias("hyphen"),
        (s.rlike("[가-힣]$") & ~s.rlike(KOREAN_TERMINAL) & (F.length(rstrip(c)) >= 25)).alias("korean"), s.rlike("^[가-힣]").alias("hangul"), s.rlike(r"""^[\p{Ll}\p{Nd}"'(\[]""").alias("low"))))


def join(left: Column, right: Column) -> Column:
    """Whether the line with joints ``right`` continues one that was wrapped after ``left``."""
    return left["open"] & right["plain"] & (left["hyphen"] | (left["korean"] & right["hangul"]) | right["low"])


def merges(left: Column, right: Column) -> Column:
    """Whether ``right`` continues a line that was wrapped after ``left``."""
    return join(joints(left), joints(right))


def adjacent(ls: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Whether two neighbours of an array pass ``test``."""
    n = lambda v: F.greatest(F.size(v) - 1, F.lit(0))
    return let(ls, lambda v: F.exists(F.zip_with(F.slice(v, 1, n(v)), F.slice(v, 2, n(v)), test), lambda x: F.coalesce(x, F.lit(False))))


def undecorated(c: Column) -> Column:
    """A text without comment lines, separators and Markdown marks; table rows become their cells."""

    def one(line: Column) -> Column:
        row = F.array_join(F.filter(cells(line), lambda x: x != ""), " ")
        plain = F.regexp_replace(F.regexp_replace(line, r"^\s{0,3}#{1,6}\s+", ""), r"^\s*[-*+]\s+", "")
        return F.regexp_replace(F.when(table_line(line) & ~F.lower(strip(line)).startswith("<table"), row).otherwise(plain), r"\*\*([^*]+)\*\*", "$1")

    kept = F.filter(lines(c), lambda x: ~x.rlike(r"^\s*<!--.*-->\s*$") & ~separator_line(x))
    return join_lines(F.transform(kept, one))


def n_paragraphs(c: Column) -> Column:
    """Non-blank pieces between blank lines."""
    return F.size(F.filter(F.split(strip(c), r"\n\s*\n", -1), lambda p: ~blank(p)))
