"""Line transforms as array expressions: a document stays in its row, so nothing is shuffled.

Each takes and returns the text; a final line end is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T


def _over_lines(text: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` on the text's lines, which are split once."""
    done = T.let(T.let(T.lines(text), change), T.join_lines)
    return T.let(done, lambda out: F.when(text.endswith("\n") & (out != ""), F.concat(out, F.lit("\n"))).otherwise(out))


def _before(ls: Column, i: Column) -> Column:
    return F.get(ls, i - 1)


def collapse_blank_lines(text: Column) -> Column:
    """Runs of blank lines become one empty line."""

    def change(ls: Column) -> Column:
        kept = F.filter(ls, lambda x, i: ~(T.blank(x) & F.coalesce(T.blank(_before(ls, i)), F.lit(False))))
        return F.transform(kept, lambda x: F.when(T.blank(x), "").otherwise(x))

    return _over_lines(text, change)


def remove_repeated_lines(text: Column) -> Column:
    """A line goes if the last full line before it is the same, case aside."""

    def change(ls: Column) -> Column:
        # Among full lines only a neighbour can repeat; blank lines stay where they are.
        pairs = F.filter(F.transform(ls, lambda x, i: F.struct(F.lower(T.strip(x)).alias("x"), i.alias("i"))), lambda s: s["x"] != "")
        gone = T.let(pairs, lambda full: F.transform(F.filter(full, lambda s, k: F.coalesce(F.get(full, k - 1)["x"] == s["x"], F.lit(False))), lambda s: s["i"]))
        return T.let(gone, lambda g: F.filter(ls, lambda x, i: ~F.array_contains(g, i)))

    return _over_lines(text, change)


def remove_duplicate_headings(text: Column) -> Column:
    """Of headings with one text, case aside, the first stays."""

    def change(ls: Column) -> Column:
        found = F.transform(ls, lambda x: F.when(x.rlike(T.HEADING), F.lower(T.strip(F.regexp_extract(x, T.HEADING, 1)))))
        return T.let(found, lambda heads: F.filter(ls, lambda x, i: F.get(heads, i).isNull() | (F.array_position(heads, F.get(heads, i)) == i + 1)))

    return _over_lines(text, change)


def strip_images(text: Column) -> Column:
    """Image links go; lines of nothing else go whole."""

    def change(ls: Column) -> Column:
        kept = F.filter(ls, lambda x: ~T.strip(x).rlike(rf"^(?:{T.IMAGE})$"))
        return F.transform(kept, lambda x: T.rstrip(F.regexp_replace(F.regexp_replace(x, T.IMAGE, ""), r"\s{2,}", " ")))

    return _over_lines(text, change)


def normalize_table_layout(text: Column) -> Column:
    """Rows with two bars or more are written anew as ``| a | b |``, without images."""

    def one(x: Column) -> Column:
        clean = T.strip(F.regexp_replace(x, T.IMAGE, ""))
        return F.when((T.count(clean, "|") >= 2), F.concat(F.lit("| "), F.array_join(T.cells(clean), " | "), F.lit(" |"))).otherwise(x)

    return _over_lines(text, lambda ls: F.transform(ls, one))


def remove_boundary_lines(text: Column) -> Column:
    """Short plain lines beside a blank line go if two or more are the same; then blanks collapse."""

    def beside(ls: Column) -> Column:
        near = lambda i: T.blank(F.coalesce(F.get(ls, i - 1), F.lit(""))) | T.blank(F.coalesce(F.get(ls, i + 1), F.lit("")))
        return F.transform(ls, lambda x, i: (i == 0) | (i == F.size(ls) - 1) | near(i))

    def repeated(ls: Column, edge: Column) -> Column:
        found = F.filter(F.transform(ls, lambda x, i: F.when(F.get(edge, i) & T.boundary(x), F.lower(T.strip(x)))), lambda x: x.isNotNull())
        return T.let(found, lambda f: F.array_distinct(F.filter(f, lambda x, i: F.array_position(f, x) < i + 1)))

    def clean(ls: Column, edge: Column, again: Column) -> Column:
        kept = T.join_lines(F.filter(ls, lambda x, i: ~(F.get(edge, i) & F.array_contains(again, F.lower(T.strip(x))))))
        bare = F.regexp_replace(collapse_blank_lines(kept), r"^\n+|\n+$", "")
        done = T.let(bare, lambda t: F.when(text.endswith("\n") & (t != ""), F.concat(t, F.lit("\n"))).otherwise(t))
        return F.when((F.size(ls) < 3) | (F.size(again) == 0), text).otherwise(done)

    return T.let(T.lines(text), lambda ls: T.let(beside(ls), lambda edge: T.let(repeated(ls, edge), lambda again: clean(ls, edge, again))))


def has_duplicate_headings(text: Column) -> Column:
    found = F.filter(F.transform(T.lines(text), lambda x: F.when(x.rlike(T.HEADING), F.lower(T.strip(F.regexp_extract(x, T.HEADING, 1))))), lambda x: x.isNotNull())
    return T.let(found, lambda heads: F.size(heads) > F.size(F.array_distinct(heads)))


def has_layout_noise(text: Column) -> Column:
    return F.exists(T.lines(text), T.corrupted_row)


def has_key_value_run(text: Column) -> Column:
    """Two neighbouring key/value lines."""
    return T.adjacent(T.lines(text), lambda a, b: T.key_value(a) & T.key_value(b))


def has_wrapped_lines(text: Column) -> Column:
    return T.adjacent(F.transform(T.lines(text), T.joints), T.join)


def has_images(text: Column) -> Column:
    return text.rlike(T.IMAGE)


def first_index(text: Column, test: Callable[[Column, Column, Column], Column]) -> Column:
    """Number of the first line that passes test(lines, line, number); null if none."""
    return T.let(T.lines(text), lambda ls: F.get(F.filter(F.transform(ls, lambda x, i: F.when(test(ls, x, i), i)), lambda i: i.isNotNull()), F.lit(0)))


def first_duplicate_line(text: Column) -> Column:
    """First line of over five characters that occurred before."""
    def first(norm: Column) -> Column:
        return F.get(F.filter(F.transform(norm, lambda x, i: F.when((F.length(x) > 5) & (F.array_position(norm, x) < i + 1), i)), lambda i: i.isNotNull()), F.lit(0))

    return T.let(F.transform(T.lines(text), T.normalize), first)


def first_wrapped_line(text: Column) -> Column:
    def first(js: Column) -> Column:
        return F.get(F.filter(F.transform(js, lambda x, i: F.when(T.join(x, F.get(js, i + 1)), i)), lambda i: i.isNotNull()), F.lit(0))

    return T.let(F.transform(T.lines(text), T.joints), first)


def first_corrupted_row(text: Column) -> Column:
    return first_index(text, lambda ls, x, i: T.corrupted_row(x))


def first_blank_run(text: Column, length: int = 3) -> Column:
    def test(ls: Column, x: Column, i: Column) -> Column:
        own = T.blank(x)
        for k in range(1, length):
            own = own & F.coalesce(T.blank(F.get(ls, i + k)), F.lit(False))
        return own & ~F.coalesce(T.blank(F.get(ls, i - 1)), F.lit(False))

    return first_index(text, test)


def issue_window(text: Column, anchor: Column, size: int = 60) -> Column:
    """Lines around an anchor: (start, end exclusive, text)."""
    ls = T.lines(text)
    start = F.greatest(F.lit(0), anchor - size // 2)
    end = F.least(F.size(ls), anchor + size // 2 + 1)
    return F.struct(start.alias("start"), end.alias("end"), T.join_lines(F.slice(ls, start + 1, F.greatest(end - start, F.lit(0)))).alias("text"))
