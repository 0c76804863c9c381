"""Lines that a candidate lost, and where they belong: anti-joins and nearest anchors.

Nearest present lines before and after come from one window per direction over a document's
lines (``last`` and ``first`` ignoring nulls), not from a theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions import text as T
from quillspark.operators import tokens as K
from quillspark.operators.metrics import dealt, exploded


def present_lines(df: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """keys, norm, first_line: each distinct normalised line of the candidate and where it first stands."""
    rows = exploded(df, keys, candidate).withColumn("norm", T.normalize(F.col("line"))).filter("norm <> ''")
    return rows.groupBy(*keys, "norm").agg(F.min("line_no").alias("first_line"))


def missing_lines(df: DataFrame, keys: list[str], source: str, candidate: str, wanted=T.structured_source) -> DataFrame:
    """Source lines (structured ones) that the candidate lacks, with the nearest present lines.

    keys, line_no, line, previous_anchor, next_anchor; lines without any anchor are left out.
    """
    df = dealt(df, keys)
    rows = exploded(df, keys, source).withColumn("norm", T.normalize(F.col("line")))
    joined = rows.join(present_lines(df, keys, candidate), [*keys, "norm"], "left")
    there = F.when((F.col("norm") != "") & F.col("first_line").isNotNull(), F.col("norm"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    marked = joined.withColumn("there", there).withColumns({
        "previous_anchor": F.last("there", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_anchor": F.first("there", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    lost = marked.filter((F.col("norm") != "") & F.col("there").isNull() & wanted(F.col("line")) & (F.col("previous_anchor").isNotNull() | F.col("next_anchor").isNotNull()))
    return lost.select(*keys, "line_no", T.strip(F.col("line")).alias("line"), "previous_anchor", "next_anchor")


def caption(line: Column) -> Column:
    """A table or figure caption."""
    return T.structured_source(line) & T.strip(line).rlike(T.CAPTION)


def lost_kinds(source: Column, candidate: Column) -> Column:
    """(lines, captions): whether :func:`missing_lines` finds any, and captions among them; within the row."""

    def lost(ls: Column, own: Column, there: Column) -> Column:
        gone = F.array_except(own, F.concat(there, F.array(F.lit(""))))
        of = lambda test: F.arrays_overlap(F.transform(F.filter(ls, test), T.normalize), gone)
        return F.when(F.arrays_overlap(own, there), F.struct(of(T.structured_source).alias("lines"), of(caption).alias("captions")))

    full = lambda text: F.filter(F.transform(T.lines(text), T.normalize), lambda x: x != "")
    return T.let(T.lines(source), lambda ls: T.let(F.transform(ls, T.normalize), lambda own: T.let(full(candidate), lambda there: lost(ls, own, there))))


def missing_captions(df: DataFrame, keys: list[str], source: str, candidate: str) -> DataFrame:
    return missing_lines(df, keys, source, candidate, caption)


def recover_lines(df: DataFrame, keys: list[str], source: str, candidate: str, wanted=T.structured_source) -> DataFrame:
    """The candidate with lost lines before their next anchor, else behind the previous one; each once."""
    df = dealt(df, keys)
    lost = missing_lines(df, keys, source, candidate, wanted).withColumn("norm", T.normalize(F.col("line")))
    once = lost.groupBy(*keys, "norm").agg(F.min_by(F.struct("line_no", "line", "previous_anchor", "next_anchor"), "line_no").alias("m")).select(*keys, "m.*")
    places = present_lines(df, keys, candidate)
    after = places.select(*keys, F.col("norm").alias("next_anchor"), F.col("first_line").alias("n"))
    before = places.select(*keys, F.col("norm").alias("previous_anchor"), F.col("first_line").alias("p"))
    put = once.join(after, [*keys, "next_anchor"], "left").join(before, [*keys, "previous_anchor"], "left")
    put = put.select(*keys, F.coalesce("n", F.col("p") + 1).alias("at"), F.lit(0).alias("own"), "line_no", "line")
    own = exploded(df, keys, candidate).select(*keys, F.col("line_no").alias("at"), F.lit(1).alias("own"), "line_no", "line")
    joined = own.unionByName(put).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "own", "line_no", "line"))).alias("ls"))
    return df.select(*keys).join(joined, keys, "left").select(*keys, F.coalesce(F.array_join(F.transform("ls", lambda s: s["line"]), "\n"), F.lit("")).alias("recovered"))


def line_covered(df: DataFrame, keys: list[str], source: str, candidate: str, share: float = 0.7) -> DataFrame:
    """Per source line with tokens: how many, how many the candidate knows, and whether enough are."""
    sums = df.select(*keys, F.inline(K.by_line(F.col(source), F.col(candidate))))
    return sums.withColumn("covered", F.col("n_known") >= F.col("n_tokens") * F.lit(share))


def page_ids(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the page of the last marker above; null before the first."""
    number = F.when(T.strip(F.col("line")).rlike(T.PAGE_MARKER), F.regexp_extract(T.strip(F.col("line")), T.PAGE_MARKER, 1).cast("int"))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page", F.last(number, True).over(w))


def page_segments(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, start (the marker's line), end (exclusive)."""
    marks = lines.filter(T.strip(F.col("line")).rlike(T.PAGE_MARKER)).withColumn("page", F.regexp_extract(T.strip(F.col("line")), T.PAGE_MARKER, 1).cast("int"))
    n = lines.groupBy(*keys).agg((F.max("line_no") + 1).alias("n"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    return marks.withColumn("next", F.lead("line_no").over(w)).join(n, keys).select(*keys, "page", F.col("line_no").alias("start"), F.coalesce("next", "n").alias("end"))


def title_share(titles: Column, candidate: Column) -> Column:
    """Share of titles found in the candidate; null without titles."""
    plain = lambda c: T.normalize(F.regexp_replace(c, r"(?m)^\s{0,3}#{1,6}\s+", ""))

    def share(hay: Column) -> Column:
        found = F.size(F.filter(F.transform(titles, plain), lambda t: (t != "") & F.contains(hay, t)))
        return F.when(F.size(titles) > 0, found.cast("double") / F.nullif(F.size(titles), F.lit(0)))

    return T.let(plain(candidate), share)


def toc_coverage(df: DataFrame, toc: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """Share of titles (keys, title) found in the candidate; null without titles."""
    titles = toc.groupBy(*keys).agg(F.collect_list("title").alias("titles"))
    joined = df.select(*keys, F.col(candidate).alias("candidate")).join(titles, keys, "left")
    return joined.select(*keys, title_share(F.col("titles"), F.col("candidate")).alias("toc_coverage"))


def label_coverage(source: Column, candidate: Column) -> Column:
    """(labels in the source, labels found in the candidate, share): distinct table labels."""
    wanted, there = L.table_labels(source), L.table_labels(candidate)
    n, hit = F.size(wanted), F.size(F.array_intersect(wanted, there))
    return F.struct(n.alias("n_labels"), hit.alias("n_found"), F.when(n > 0, hit.cast("double") / F.nullif(n, F.lit(0))).alias("share"))


def best_overlap_line(df: DataFrame, keys: list[str], query: str, candidate: str, least: float = 0.5) -> DataFrame:
    """The candidate line with the largest share of its tokens in the query text; null below ``least``."""
    asked = df.select(*keys, F.explode(F.array_distinct(T.words(F.col(query)))).alias("token")).withColumn("hit", F.lit(1))
    rows = exploded(df, keys, candidate).select(*keys, "line_no", F.explode(F.array_distinct(T.words(F.col("line")))).alias("token"))
    scored = rows.join(asked, [*keys, "token"], "left").groupBy(*keys, "line_no").agg((F.count("hit").cast("double") / F.count("*")).alias("share"))
    best = scored.filter(F.col("share") >= least).groupBy(*keys).agg(F.max_by("line_no", F.struct(F.col("share"), -F.col("line_no"))).alias("best_line"))
    return df.select(*keys).join(best, keys, "left")

