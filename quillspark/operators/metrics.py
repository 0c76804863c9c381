"""Fidelity metrics of a candidate against its source.

Line and table counts are expressions within the document's row and move nothing.
Token coverage and F1 compare multisets, which Arrow batches count within the row too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as T
from quillspark.operators import tokens as K

KINDS = ("heading", "list", "table")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by their keys once: every text travels once, and aggregations and joins by the keys stay in place."""
    return df.repartition(*keys)


def text_coverage(df: DataFrame, keys: list[str], source: str, candidate: str) -> DataFrame:
    """Share of the source's tokens (as a multiset) found in the candidate.

    Without source tokens it is 1 if the candidate is blank, else 0.
    """
    rows = df.select(*keys, K.sums(F.col(source), F.col(candidate)).alias("_tokens"), T.blank(F.col(candidate)).alias("_blank"))
    return rows.select(*keys, coverage(F.col("_tokens"), F.col("_blank")).alias("text_coverage"))


def coverage(tokens: Column, blank: Column) -> Column:
    """Text coverage from :func:`quillspark.operators.tokens.sums` and whether the candidate is blank."""
    n = tokens["n_source"]
    return F.when(n == 0, F.when(blank, 1.0).otherwise(0.0)).otherwise(tokens["n_common"].cast("double") / F.nullif(n, F.lit(0)))


def content_f1(df: DataFrame, keys: list[str], source: str, candidate: str) -> DataFrame:
    """Multiset F1 of tokens: what similarity becomes for long texts."""
    rows = df.select(*keys, K.sums(F.col(source), F.col(candidate)).alias("_tokens"))
    both = F.col("_tokens.n_source") + F.col("_tokens.n_candidate")
    return rows.select(*keys, F.when(both == 0, 1.0).otherwise(2.0 * F.col("_tokens.n_common") / F.nullif(both, F.lit(0))).alias("content_f1"))


def facts(text: Column) -> Column:
    """What the line metrics need of a text, from one pass: its stripped lines and their kinds."""
    return T.let(F.transform(T.lines(text), T.strip), lambda ss: F.struct(ss.alias("stripped"), F.transform(ss, T._kind).alias("kinds")))


def _n(f: Column, kind: str) -> Column:
    return F.size(F.filter(f["kinds"], lambda k: F.coalesce(k == kind, F.lit(False))))


def _structure(a: Column, b: Column, source: Column, candidate: Column) -> Column:
    """Structure retention from the facts of both texts."""
    pairs = F.array(*(F.struct(_n(a, k).alias("e"), _n(b, k).alias("a")) for k in KINDS))

    def score(present: Column) -> Column:
        mean = F.aggregate(present, F.lit(0.0), lambda acc, p: acc + S.count_similarity(p["e"], p["a"])) / F.nullif(F.size(present), F.lit(0))
        return F.when(F.size(present) > 0, S.clamp(mean)).otherwise(_plain(a, b, source, candidate))

    empty = lambda f: ~F.exists(f["stripped"], lambda x: x != "")
    return F.when(empty(a), F.when(empty(b), 1.0).otherwise(0.0)).otherwise(T.let(F.filter(pairs, lambda p: p["e"] > 0), score))


def _plain(a: Column, b: Column, source: Column, candidate: Column) -> Column:
    n = lambda f: F.size(F.filter(f["stripped"], lambda x: x != ""))
    return (S.count_similarity(n(a), n(b)) + S.count_similarity(T.n_paragraphs(source), T.n_paragraphs(candidate))) / 2


def _blank_share(f: Column) -> Column:
    ss = f["stripped"]
    extra = F.size(F.filter(ss, lambda x, i: (x == "") & (i > 0) & F.coalesce(F.get(ss, i - 1) == "", F.lit(False))))
    return extra.cast("double") / F.greatest(F.size(ss), F.lit(1))


def _repeated_share(f: Column) -> Column:
    share = lambda ls: F.when(F.size(ls) == 0, 0.0).otherwise((F.size(ls) - F.size(F.array_distinct(ls))).cast("double") / F.nullif(F.size(ls), F.lit(0)))
    return T.let(F.transform(F.filter(f["stripped"], lambda x: x != ""), T.normalize), share)


LINE_METRICS = ["structure_retention", "table_preservation", "empty_block_penalty", "repetition_penalty"]


def line_metrics(source: Column, candidate: Column) -> Column:
    """All metrics that lines decide, as a struct; each text is split and stripped once."""
    return T.let(facts(source), lambda a: T.let(facts(candidate), lambda b: F.struct(
        _structure(a, b, source, candidate).alias("structure_retention"), S.count_similarity(_n(a, "table"), _n(b, "table")).alias("table_preservation"),
        _blank_share(b).alias("empty_block_penalty"), _repeated_share(b).alias("repetition_penalty"))))


def count_kind(lines: Column, kind: str) -> Column:
    return F.size(F.filter(lines, lambda x: F.coalesce(T.kind(x) == kind, F.lit(False))))


def full_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~T.blank(x))


def plain_structure(source: Column, candidate: Column) -> Column:
    """Mean similarity of the numbers of full lines and of paragraphs."""
    return T.let(facts(source), lambda a: T.let(facts(candidate), lambda b: _plain(a, b, source, candidate)))


def structure_retention(source: Column, candidate: Column) -> Column:
    """Mean count similarity over the kinds of marked lines in the source, else the plain structure."""
    return T.let(facts(source), lambda a: T.let(facts(candidate), lambda b: _structure(a, b, source, candidate)))


def table_preservation(source: Column, candidate: Column) -> Column:
    """Count similarity of table lines."""
    return T.let(facts(source), lambda a: T.let(facts(candidate), lambda b: S.count_similarity(_n(a, "table"), _n(b, "table"))))


def structured_structure(source: Column, candidate: Column) -> Column:
    """1 if the source has no marked lines: formats whose source text carries no marks."""
    marked = lambda f: F.exists(f["kinds"], lambda k: k.isNotNull())
    return T.let(T.undecorated(candidate), lambda plain: T.let(facts(source), lambda a: F.when(marked(a), T.let(facts(plain), lambda b: _structure(a, b, source, plain))).otherwise(1.0)))


def structured_tables(source: Column, candidate: Column) -> Column:
    return T.let(facts(source), lambda a: F.when(_n(a, "table") > 0, T.let(facts(candidate), lambda b: S.count_similarity(_n(a, "table"), _n(b, "table")))).otherwise(1.0))


def blank_penalty(candidate: Column) -> Column:
    """Blank lines behind a blank line, per line."""
    return T.let(facts(candidate), _blank_share)


def repetition_penalty(candidate: Column) -> Column:
    """Full lines that equal an earlier one, per full line."""
    return T.let(facts(candidate), _repeated_share)


def content_stats(text: Column) -> Column:
    """Characters, words, full lines, headings and an estimate of table rows."""
    return T.let(T.lines(text), lambda ls: F.struct(
        F.length(text).alias("chars"), T.n_fields(text).alias("words"), F.size(full_lines(ls)).alias("lines"),
        F.size(F.filter(ls, lambda x: T.strip(x).startswith("#"))).alias("headings"), F.floor(F.size(F.filter(ls, T.any_bar)) / 2).cast("int").alias("tables"),
    ))


def pdf_cues(text: Column) -> Column:
    """Chapter, section and subsection cues of the text as one line."""
    flat = F.array_join(F.transform(full_lines(T.lines(text)), T.strip), " ")
    return F.concat(
        F.transform(F.regexp_extract_all(flat, F.lit(T.CHAPTER_CUE), 0), lambda x: F.concat(F.lit("chapter:"), T.compact(x))),
        F.transform(F.regexp_extract_all(flat, F.lit(T.SECTION_CUE), 1), lambda x: F.concat(F.lit("section:"), x)),
        F.transform(F.regexp_extract_all(flat, F.lit(T.SUBSECTION_CUE), 1), lambda x: F.concat(F.lit("subsection:"), x)),
    )


def cue_coverage(df: DataFrame, keys: list[str], source: str, candidate: str) -> DataFrame:
    return df.select(*keys, cue_share(F.col(source), F.col(candidate)).alias("cue_coverage"))


def exploded(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no (from 0), line."""
    return df.select(*keys, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def islands(lines: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """Runs of neighbouring lines that pass ``test``: keys, block_no, start, end (exclusive), block (lines)."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    hit = lines.filter(test).withColumn("run", F.col("line_no") - F.row_number().over(order))
    runs = hit.groupBy(*keys, "run").agg(F.min("line_no").alias("start"), (F.max("line_no") + 1).alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("block"))
    return runs.withColumn("block_no", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).drop("run")


def table_blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Runs of Markdown table rows.  (Tables in HTML are found by :mod:`quillspark.operators.tables`.)"""
    return islands(exploded(df, keys, text), keys, T.table_line(F.col("line")))


def column_counts(block: Column) -> Column:
    """Columns of each row; -1 for a row without a bar at both ends."""
    return F.transform(F.filter(block, lambda x: ~T.blank(x)), lambda x: F.when(T.strict_row(x), F.size(F.split(T.strip(x), r"\|", -1)) - 2).otherwise(-1))


def block_consistency(block: Column) -> Column:
    """Share of rows with the most frequent column count (ties: the first met); null for single rows."""
    def mode(positive: Column) -> Column:
        ranked = F.transform(F.array_distinct(positive), lambda v, i: F.struct(F.size(F.filter(positive, lambda y: y == v)).alias("n"), (-i).alias("i"), v.alias("v")))
        return F.array_max(ranked)["v"]

    def share(counts: Column) -> Column:
        most = T.let(F.filter(counts, lambda x: x > 0), mode)
        same = T.let(most, lambda m: F.coalesce(F.size(F.filter(counts, lambda x: x == m)), F.lit(0)))
        return F.when(F.size(counts) >= 2, F.when(most.isNull(), 0.0).otherwise(same.cast("double") / F.nullif(F.size(counts), F.lit(0))))

    return T.let(column_counts(block), share)


def row_blocks(ls: Column) -> Column:
    """Runs of neighbouring table lines of an array of lines."""

    def cut(hit: Column) -> Column:
        at = lambda i: F.coalesce(F.get(hit, i), F.lit(False))
        starts = F.filter(F.transform(hit, lambda x, i: F.when(x & ~F.when(i > 0, at(i - 1)).otherwise(F.lit(False)), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(hit, lambda x, i: F.when(x & ~at(i + 1), i + 1)), lambda i: i.isNotNull())
        return F.zip_with(starts, ends, lambda i, j: F.slice(ls, i + 1, j - i))

    return T.let(F.transform(ls, T.table_line), cut)


def consistency(text: Column) -> Column:
    """Mean column consistency over the text's table blocks; 1 without tables.  Tables in HTML do not count."""
    of = lambda block: F.when(~F.lower(T.strip(F.get(block, F.lit(0)))).startswith("<table"), block_consistency(block))
    shares = F.filter(T.let(T.lines(text), lambda ls: F.transform(row_blocks(ls), of)), lambda x: x.isNotNull())
    return T.let(shares, lambda xs: F.when(F.size(xs) == 0, 1.0).otherwise(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(xs), F.lit(0))))


def table_consistency(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, consistency(F.col(text)).alias("table_consistency"))


def cue_share(source: Column, candidate: Column) -> Column:
    """Share of the source's cues (as a multiset) in the candidate; null without cues."""

    def share(wanted: Column, there: Column) -> Column:
        n = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
        hit = F.aggregate(F.array_distinct(wanted), F.lit(0), lambda acc, x: acc + F.least(n(wanted, x), n(there, x)))
        return F.when(F.size(wanted) > 0, hit.cast("double") / F.nullif(F.size(wanted), F.lit(0)))

    return T.let(pdf_cues(source), lambda wanted: T.let(pdf_cues(candidate), lambda there: share(wanted, there)))


def notes(m: dict[str, Column]) -> Column:
    """Remarks on low scores and on penalties."""
    said = [
        (m["text_coverage"] < 0.75, "Low text coverage against source."),
        (m["structure_retention"] < 0.75, "Structural markers were not retained well."),
        (m["table_preservation"] < 0.75, "Table formatting appears incomplete."),
        (m["empty_block_penalty"] > 0, "Candidate contains oversized blank sections."),
        (m["repetition_penalty"] > 0, "Candidate contains repeated non-empty lines."),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in said)), lambda x: x.isNotNull())


def more_notes(table_consistency: Column, cell_similarity: Column, image_ratio: Column, blocks_per_page: Column) -> tuple[Column, Column]:
    """Remarks that stand before and behind those on scores."""
    pictures = image_ratio.isNotNull() & ((image_ratio >= IMAGE_RATIO) | (F.coalesce(blocks_per_page, F.lit(0.0)) >= IMAGE_BLOCKS))
    seen = F.concat(F.lit("Low-confidence coverage: "), F.format_number(image_ratio * 100, 0), F.lit("% of the page area is images, whose text the source text does not hold."))
    uneven = F.concat(F.lit("Markdown table column structure inconsistent (consistency="), F.format_number(table_consistency, 2), F.lit(")."))
    unlike = F.concat(F.lit("Cell-level table similarity is low ("), F.format_number(cell_similarity, 2), F.lit(")."))
    keep = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return keep(F.when(pictures, seen)), keep(F.when(table_consistency < 0.9, uneven), F.when(cell_similarity < 0.7, unlike))


#: Share of the page area, and image blocks of a page, from which a document counts as made of images.
IMAGE_RATIO, IMAGE_BLOCKS = 0.2, 5.0

# Fixed: issue type and metric, and whether the metric is a penalty.
ISSUES = [
    ("text_coverage_missing_lines", "text_coverage", False),
    ("structure_heading_noise", "structure_retention", False),
    ("table_layout_noise", "table_preservation", False),
    ("blank_line_noise", "empty_block_penalty", True),
    ("line_repetition_noise", "repetition_penalty", True),
]


def metric_issues(m: dict[str, Column]) -> Column:
    """Issues with severity, confidence and who may repair them, for scores below 0.75 and penalties above 0."""
    made = []
    for issue, metric, penalty in ISSUES:
        value = m[metric]
        made.append(F.when(value > 0 if penalty else value < 0.75, F.struct(
            F.lit(issue).alias("issue_type"), F.lit(metric).alias("metric_name"),
            (S.penalty_severity(value) if penalty else S.severity(value)).alias("severity"), (S.clamp(value) if penalty else S.confidence(value)).alias("confidence"),
            F.lit("visual" if metric == "table_preservation" else "heuristic").alias("repairability"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def evaluate(df: DataFrame, keys: list[str], source: str = "source", candidate: str = "candidate", similarity: Column | None = None, judge: Column | None = None,
             source_class: Column | str | None = None, toc_coverage: Column | None = None, cell_similarity: Column | None = None, image_ratio: Column | None = None, blocks_per_page: Column | None = None) -> DataFrame:
    """All metrics, the total, notes, issues and failed checks for each pair.

    source_class (:func:`quillspark.sources.filetype.source_class`) chooses structure, table score and similarity:

    * ``pdf``: cues, else marked lines, at least the share of outline titles found; labelled tables, else blocks
      of numbers, at least the cell similarity if the source has no table labels; similarity without marks.
    * ``structured`` (office, data and web formats): lines and tables count only if the source text has marks;
      similarity of word streams.
    * any other: marked lines, table lines, similarity of the texts.

    Uneven table columns lower the table score by up to 30 %.  Nothing is shuffled.
    """
    from quillspark.operators import similarity as X
    from quillspark.operators import tables

    number = lambda c: (c if c is not None else F.lit(None)).cast("double")
    kind = F.lit("text" if source_class is None else source_class) if source_class is None or isinstance(source_class, str) else source_class
    own = {"_class": kind, "_toc": number(toc_coverage), "_cells": number(cell_similarity), "_image": number(image_ratio), "_blocks": number(blocks_per_page), "_judge": number(judge)}
    if similarity is not None:
        own["normalized_similarity"] = similarity
    rows = df.withColumns(own)
    s, c = F.col(source), F.col(candidate)
    classed = source_class is not None and not (isinstance(source_class, str) and source_class == "text")
    # Each step's columns are used more than once, so they are computed in a step of their own.
    scored = rows.withColumn("_m", line_metrics(s, c)).withColumns({"table_consistency": consistency(c), "_tokens": K.sums(s, c), "_empty": T.blank(c)})
    structure, table = F.col("_m.structure_retention"), F.col("_m.table_preservation")
    bare = c
    if classed:
        scored = scored.withColumn("_bare", T.undecorated(c)).withColumn("_kept", tables.pdf_table_preservation(F.when(F.col("_class") == "pdf", s), F.when(F.col("_class") == "pdf", c)))
        bare, pdf, structured = F.col("_bare"), F.col("_class") == "pdf", F.col("_class") == "structured"
        cued = F.greatest(F.coalesce(cue_share(s, c), structure), F.coalesce("_toc", F.lit(0.0)))
        structure = F.when(pdf, cued).when(structured, structured_structure(s, c)).otherwise(structure)
        table = F.when(pdf, F.col("_kept")).when(structured, structured_tables(s, c)).otherwise(table)
    if similarity is None:
        plain = X.text_similarity(s, bare if not classed else F.when(F.col("_class") == "pdf", bare).otherwise(c))
        words = X.content_similarity(F.when(F.col("_class") == "structured", s), F.when(F.col("_class") == "structured", bare)) if classed else F.lit(None)
        scored = scored.withColumn("normalized_similarity", F.when(F.col("_class") == "structured", words).otherwise(plain) if classed else plain)
    even = F.col("table_consistency")
    scored = scored.withColumn("structure_retention", structure).withColumn("table_preservation", table)
    damped = F.when(even < 1, S.clamp(F.col("table_preservation") * (0.7 + 0.3 * even))).otherwise(F.col("table_preservation"))
    if classed:
        from quillspark.functions import labels as L

        unlabelled = (F.col("_class") == "pdf") & F.col("_cells").isNotNull() & (F.size(L.table_labels(s)) == 0)
        damped = F.when(unlabelled, F.greatest(damped, F.col("_cells"))).otherwise(damped)
    scored = scored.withColumns({"table_preservation": damped, "empty_block_penalty": F.col("_m.empty_block_penalty"), "repetition_penalty": F.col("_m.repetition_penalty")})
    rows = scored.withColumn("text_coverage", coverage(F.col("_tokens"), F.col("_empty")))
    m = {k: F.col(k) for k in ("text_coverage", "structure_retention", "table_preservation", "empty_block_penalty", "repetition_penalty")}
    total = S.total_score(m["text_coverage"], F.col("normalized_similarity"), m["structure_retention"], m["table_preservation"], m["empty_block_penalty"], m["repetition_penalty"], F.col("_judge") if judge is not None else None)
    first, last = more_notes(even, F.when(F.col("_class") == "pdf", F.col("_cells")), F.col("_image"), F.col("_blocks"))
    rows = rows.withColumn("total_score", total).withColumn("table_cell_similarity", F.col("_cells"))
    out = rows.withColumns({"notes": F.concat(first, notes(m), last), "issues": metric_issues(m), "gate_failures": S.gate_failures(F.col("total_score"), m["text_coverage"])})
    return out.drop("_m", "_bare", "_kept", "_tokens", "_empty", *(k for k in own if k.startswith("_")))
