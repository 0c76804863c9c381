"""Planning of visual table repairs, and what is done with their answers: expressions over a document's row.

A parser tells table regions, where labels stand and which table is where, in its own
view and in those of other parsers.  No vision engine is needed to plan, only to recover.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import grids as G
from quillspark.functions import labels as L
from quillspark.functions import text as T

REGION = "struct<page:int,x0:double,y0:double,x1:double,y1:double,table_id:string,label:string,mode:string,continued_from:int,rows:int,columns:int>"
TASK = "struct<task_id:string,table_label:string,page_number:int,issue_types:array<string>,output:string>"
#: Fixed: issue types whose tables are asked for as HTML, and statuses after which a call is tried again.
SPANNING = ["merged_cell_loss", "split_multipage_table"]
RETRYABLE = [408, 409, 429]
MOST_TASKS, LEAST_PRESERVED = 3, 0.9


# Views of several parsers


def all_regions(own: Column, others: Column) -> Column:
    """Regions of the parser and of the others, in this order."""
    none = F.array().cast(f"array<{REGION}>")
    return F.concat(F.coalesce(own, none), F.flatten(F.filter(F.coalesce(others, F.array().cast(f"array<array<{REGION}>>")), lambda x: x.isNotNull())))


def first_regions(own: Column, others: Column) -> Column:
    """The first view's regions that are not empty."""
    return F.coalesce(F.get(F.filter(F.concat(F.array(own), others), lambda x: F.size(x) > 0), F.lit(0)), F.array().cast(f"array<{REGION}>"))


def first_wins(own: Column, others: Column, kind: str) -> Column:
    """One map of all views; a key keeps the value of the first view that has one."""
    empty = F.create_map().cast(f"map<string,{kind}>")
    full = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    add = lambda acc, m: F.map_concat(acc, F.map_filter(full(m), lambda k, v: ~F.map_contains_key(acc, k)))
    return F.aggregate(F.coalesce(others, F.array().cast(f"array<map<string,{kind}>>")), F.coalesce(full(own), empty), add)


def label_pages(own: Column, others: Column) -> Column:
    """Label to page number, from maps of strings; values that are no numbers are left out."""
    number = lambda m: F.transform_values(m, lambda k, v: v.try_cast("int"))
    return first_wins(number(own), F.transform(others, number), "int")


def label_positions(own: Column, others: Column) -> Column:
    """Label to (page, region_index, global_index); places that lack a number are left out."""
    place = "struct<page:int,region_index:int,global_index:int>"
    whole = lambda m: F.map_filter(m, lambda k, v: v["page"].isNotNull() & v["region_index"].isNotNull() & v["global_index"].isNotNull())
    return first_wins(whole(own), F.transform(others, whole), place)


def slots(raw: Column) -> Column:
    return F.coalesce(raw, F.slice(F.coalesce(raw, F.array().cast("array<string>")), 1, 0))


def merged_metadata(regions: Column, other_regions: Column, pages: Column, other_pages: Column, table_format: Column, other_format: Column) -> Column:
    """The parser's own view before the other's."""
    return F.struct(
        F.when(F.size(regions) > 0, regions).otherwise(other_regions).alias("regions"), F.map_concat(F.map_filter(other_pages, lambda k, v: ~F.map_contains_key(pages, k)), pages).alias("label_pages"), F.coalesce(table_format, other_format).alias("table_format"),
    )


# Regions


def troubled(region: Column) -> Column:
    """Only referred to, or the rest of a table of another page."""
    return F.coalesce(region["mode"] == "reference", F.lit(False)) | region["continued_from"].isNotNull()


def prefers_html(issue_types: Column, regions: Column, formats: Column) -> Column:
    """Spans matter to the issues, a parser gives HTML, or a region is troubled."""
    spans = F.exists(issue_types, lambda x: x.isin(SPANNING))
    return spans | F.exists(formats, lambda x: F.coalesce(F.lower(x) == "html", F.lit(False))) | F.exists(regions, troubled)


def page_regions(page: Column, regions: Column) -> Column:
    """A page's regions from top to bottom, then from left to right."""
    own = F.filter(regions, lambda r: F.coalesce(r["page"] == page, F.lit(False)))
    keyed = F.transform(own, lambda r, i: F.struct(F.coalesce(r["y0"], F.lit(0.0)).alias("y"), F.coalesce(r["x0"], F.lit(0.0)).alias("x"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(a["i"] - b["i"])), lambda s: s["r"])


def ambiguous_page(page: Column, regions: Column) -> Column:
    return F.size(F.filter(regions, lambda r: F.coalesce(r["page"] == page, F.lit(False)))) > 1


def reference_line(region: Column) -> Column:
    """What stands for a table that could not be written out."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    box = F.when(region["x0"].isNotNull(), F.concat_ws(",", *(region[k].cast("string") for k in ("x0", "y0", "x1", "y1")))).otherwise("unknown")
    return F.concat(F.lit("[Table reference: id="), show(region["table_id"]), F.lit(" page="), show(region["page"]), F.lit(" bbox="), box, F.lit(" rows="), show(region["rows"]), F.lit(" cols="), show(region["columns"]), F.lit("]"))


# Tasks


def _task(kind: str, label: Column, page: Column, index: Column, issue_types: Column, html: Column) -> Column:
    name = F.concat(F.lit(f"visual-{kind}-"), page.cast("string"), F.lit("-"), index.cast("string"))
    return F.struct(name.alias("task_id"), label.alias("table_label"), page.cast("int").alias("page_number"), issue_types.alias("issue_types"), F.when(html, "html").otherwise("markdown").alias("output")).cast(TASK)


def region_tasks(regions: Column, issue_types: Column, html: Column, most: int = MOST_TASKS) -> Column:
    """A task for each troubled region, by page and place on it."""
    pages = F.array_sort(F.array_distinct(F.transform(F.filter(regions, lambda r: troubled(r) & (r["page"] > 0)), lambda r: r["page"])))

    def on(page: Column) -> Column:
        rows = F.transform(page_regions(page, regions), lambda r, i: F.struct(troubled(r).alias("t"), (i + 1).alias("i")))
        return F.transform(F.filter(rows, lambda s: s["t"]), lambda s: _task("region-table", L.page_label(page, s["i"]), page, s["i"], issue_types, html))

    return F.slice(F.flatten(F.transform(pages, on)), 1, most)


def finding_page(label: Column, claimed: Column, pages: Column, n_pages: Column, label_of_page: Column | None = None) -> Column:
    """The claimed page if it exists (and, if known, holds the label), else the label's page, else that in its own name."""
    good = L.valid_page(claimed, n_pages)
    if label_of_page is not None:
        good = good & F.coalesce(label_of_page == claimed, F.lit(True))
    return F.coalesce(F.when(good, claimed), F.try_element_at(pages, label), L.page_selector(label)["page"])


def plan_tasks(is_pdf: Column, table_issues: Column, targets: Column, findings: Column, labels: Column, pages_named: Column, table_preservation: Column, regions: Column, pages: Column, n_pages: Column, formats: Column, most: int = MOST_TASKS) -> Column:
    """Array of tasks from the first tier that gives any: routed targets, judge findings, labels and pages that remarks name, troubled regions.

    targets and findings: arrays of (table_label, page_number); labels: in order of priority.
    Only PDFs with table issues have tasks.
    """
    none = F.array().cast(f"array<{TASK}>")
    html = prefers_html(table_issues, regions, formats)

    def of(found: Column, kind: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            page = finding_page(F.coalesce(x["table_label"], F.lit("")), x["page_number"], pages, n_pages)
            label = F.coalesce(F.nullif(T.strip(x["table_label"]), F.lit("")), L.page_label(page))
            return F.when(page.isNotNull(), _task(kind, label, page, i, table_issues, html))

        return F.filter(F.transform(F.slice(F.coalesce(found, F.slice(findings, 1, 0)), 1, most), one), lambda t: t.isNotNull())

    def by_label(label: Column, i: Column) -> Column:
        page = F.coalesce(F.try_element_at(pages, label), L.page_selector(label)["page"])
        return F.when(page.isNotNull(), _task("table", label, page, i, table_issues, html))

    def by_page(page: Column) -> Column:
        own = page_regions(page, regions)
        each = F.transform(own, lambda r, i: _task("page-table", L.page_label(page, i + 1), page, i + 1, table_issues, html))
        return F.when(F.size(own) > 0, each).otherwise(F.array(_task("page-table", L.page_label(page), page, F.lit(0), table_issues, html)))

    named = F.filter(F.transform(F.slice(labels, 1, most), by_label), lambda t: t.isNotNull())
    paged = F.when(table_preservation < LEAST_PRESERVED, F.slice(F.flatten(F.transform(pages_named, by_page)), 1, most)).otherwise(none)
    tiers = [of(targets, "target-table"), of(findings, "structured-table"), named, paged, region_tasks(regions, table_issues, html, most)]
    first = F.get(F.filter(F.array(*tiers), lambda t: F.size(t) > 0), F.lit(0))
    return F.when(is_pdf & (F.size(table_issues) > 0), F.coalesce(first, none)).otherwise(none)


def spread(found: Column, limit: int) -> Column:
    """At most ``limit`` items, evenly spaced over the array."""
    if limit <= 0:
        return F.slice(found, 1, 0)

    def thinned(xs: Column) -> Column:
        at = lambda i: F.bround(i * (F.size(xs) - 1) / (limit - 1)).cast("int") if limit > 1 else F.lit(0)
        return F.when(F.size(xs) <= limit, xs).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(xs, at(i))))

    return T.let(found, thinned)


def selected_labels(source: Column, candidate: Column, limit: int) -> Column:
    """Distinct labels of both texts in order of first appearance, thinned evenly."""
    return spread(F.array_distinct(F.concat(L.judged_labels(source), L.judged_labels(candidate))), limit)


def has_table_cues(text: Column) -> Column:
    """A label, an HTML table, or two table rows."""
    rows = F.filter(T.lines(text), T.markdown_row)
    return text.rlike(L.JUDGED) | F.lower(text).contains("<table") | (F.size(rows) >= 2)


def retryable(status: Column) -> Column:
    """Whether a call is worth another try; no status is a network error."""
    return status.isNull() | status.isin(RETRYABLE) | (status >= 500)


def distinct_neighbours(items: Column) -> Column:
    """Without items that equal the one before."""
    return F.filter(items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - 1)))


# Excerpts and answers


def page_section(text: Column, page: Column) -> Column:
    """Lines of a page: behind its marker, up to the next."""
    marker = F.concat(F.lit("<!-- page "), page.cast("string"), F.lit(" -->"))

    def cut(ls: Column) -> Column:
        start = F.array_position(F.transform(ls, T.strip), marker)
        rest = F.slice(ls, start + 1, F.greatest(F.size(ls) - start, F.lit(0)).cast("int"))
        end = F.array_position(F.transform(rest, lambda x: T.strip(x).rlike(T.PAGE_MARKER)), True)
        return F.when(F.coalesce(start, F.lit(0)) == 0, F.slice(ls, 1, 0)).when(end > 0, F.slice(rest, 1, (end - 1).cast("int"))).otherwise(rest)

    return T.let(T.lines(text), cut)


def label_excerpt(text: Column, label: Column, size: int = 14) -> Column:
    """Lines from a label's first place on, or of the page that a scoped label names."""
    page = L.page_selector(label)["page"]
    number = L.label_number(label)

    def near(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, lambda x: F.contains(x, number)), True)
        return F.when(at > 0, F.slice(ls, at.cast("int"), size)).otherwise(F.slice(ls, 1, 0))

    own = F.when(page.isNotNull(), F.slice(page_section(text, page), 1, size)).when(number.isNotNull(), T.let(T.lines(text), near))
    return T.strip(F.coalesce(T.join_lines(own), F.lit("")))


def normalized_cell(text: Column) -> Column:
    """Line ends of a recovered cell as <br>, white space collapsed."""
    flat = F.regexp_replace(T.strip(F.replace(text, F.lit(" "), F.lit(" "))), r"\s*\n\s*", "<br>")
    return T.strip(F.regexp_replace(flat, r"[ \t]+", " "))


def normalized_markup(markdown: Column) -> Column:
    """A recovered table (HTML tables are Markdown by now) without images and tags, with units and decimals mended."""
    c = F.regexp_replace(markdown, T.IMAGE, "")
    for pattern, by in (
        (r"(?i)<br\s*/?>", " "), (r"</?[A-Za-z][^>]*>", ""), ("km²", "㎢"), (r"((?:총|기)?매립\s*용량\s*)\(\s*㎡\s*\)", "$1(㎥)"), (r"(잔여\s*매립\s*가능량\s*)\(\s*㎡\s*\)", "$1(㎥)"),
        (r"(?<![0-9])([0-9]{1,3}),([0-9])(?![0-9])", "$1.$2"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return T.strip(c)


def recovery(answer: Column, label: Column, page: Column) -> Column:
    """(table_label, page_number, confidence, markdown) of an answer: its JSON, else a table in it with confidence 0.7."""
    from quillspark.operators import judging

    j = judging.verdict_json(answer)
    get = lambda k: F.nullif(F.get_json_object(j, f"$.{k}"), F.lit(""))
    rows = F.filter(T.lines(answer), T.full_row)
    found = F.coalesce(F.when(F.size(rows) >= 2, T.join_lines(rows)), F.nullif(F.regexp_extract(answer, r"(?is)(<table\b.*?</table>)", 1), F.lit("")))
    markup = F.coalesce(get("markdown"), get("table"), get("html"))
    given = F.coalesce(get("confidence").try_cast("double"), F.lit(0.7))
    return F.struct(
        F.coalesce(get("table_label"), label).alias("table_label"), F.coalesce(get("page_number").try_cast("int"), page.cast("int")).alias("page_number"),
        F.when(j.isNotNull(), given).when(found.isNotNull(), 0.7).alias("confidence"), F.when(j.isNotNull(), markup).otherwise(found).alias("markdown"),
    )


def rejection(available: bool, page: Column, n_pages: Column, error: Column, markdown: Column, confidence: Column, grounding: Column, sane: Column, changed: Column) -> Column:
    """Why a recovered table is not taken over, in order of the checks; null if it is."""
    clean = normalized_markup(markdown)
    return (
        F.when(F.lit(not available), "no_visual_recoverer").when(n_pages.isNotNull() & ~L.valid_page(page, n_pages), "page_out_of_range").when(error.isNotNull(), "recover_exception")
        .when(F.coalesce(T.strip(markdown), F.lit("")) == "", "empty_recovery").when(confidence < 0.45, "low_confidence").when(grounding < 0.5, "content_mismatch").when(clean == "", "normalize_failed")
        .when(~sane, "sanity_check_failed").when(~changed, "patch_target_not_found")
    )


# Cells and words of a page


def cell_spans(cells: Column, n_rows: Column, n_columns: Column) -> Column:
    """Map of cell number (by rows) to (rows, columns) it spans; equal boxes are one cell, its first place holds the span.

    cells: array of boxes (null for none), row after row.  Empty if the numbers do not fit.
    """
    from quillspark.functions.geometry import key

    def made(keys: Column) -> Column:
        place = lambda i: F.struct(F.floor(i / n_columns).cast("int").alias("r"), (i % n_columns).cast("int").alias("c"))
        same = lambda k: F.transform(F.filter(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"))), lambda s: s["k"] == k), lambda s: place(s["i"]))
        size = lambda ps, f: F.array_max(F.transform(ps, f)) - F.array_min(F.transform(ps, f)) + 1
        firsts = F.filter(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"), (F.array_position(keys, x) == i + 1).alias("first"))), lambda s: s["k"].isNotNull() & s["first"])
        span = lambda s: F.struct(s["i"].alias("cell"), F.struct(size(same(s["k"]), lambda p: p["r"]).alias("rows"), size(same(s["k"]), lambda p: p["c"]).alias("columns")).alias("span"))
        return F.map_from_entries(F.transform(firsts, span))

    fits = (n_rows > 0) & (n_columns > 0) & (F.size(cells) == n_rows * n_columns)
    return F.when(fits, T.let(F.transform(cells, lambda c: F.when(c["x1"] > c["x0"], key(c))), made))


def text_from_words(words: Column, box: Column, raw: Column) -> Column:
    """A block's text from the words that lie in it (80 % at least), unless that loses over a fifth of it.

    words: array of (x0, y0, x1, y1, text, line, word).
    """
    from quillspark.functions.geometry import overlap_ratio

    inside = F.filter(words, lambda w: overlap_ratio(F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1")), box) >= 0.8)
    keyed = F.array_sort(F.transform(inside, lambda w: F.struct(w["line"].alias("l"), w["y0"].alias("y"), w["x0"].alias("x"), w["word"].alias("n"), w["text"].alias("t"))))

    def joined(ws: Column) -> Column:
        fresh = lambda w, i: (w["l"] != F.get(ws, i - 1)["l"]) | (F.round(w["y"], 1) != F.round(F.get(ws, i - 1)["y"], 1))
        return F.array_join(F.transform(ws, lambda w, i: F.concat(F.when(i == 0, "").when(fresh(w, i), "\n").otherwise(" "), w["t"])), "")

    def kept(text: Column) -> Column:
        return F.when((F.size(inside) == 0) | (text == "") | (F.length(T.compact(text)) < F.length(T.compact(raw)) * 0.8), raw).otherwise(text)

    return T.let(T.let(keyed, joined), kept)


# Workflow


#: The control graph: stage to the stages that may follow.
GRAPH = [
    ("parse_document", "evaluate_candidate"), ("evaluate_candidate", "inspect_quality_issues"), ("evaluate_candidate", "finalize_output"), ("inspect_quality_issues", "route_repair_strategy"),
    ("inspect_quality_issues", "finalize_output"), ("route_repair_strategy", "repair_candidate"), ("route_repair_strategy", "finalize_output"), ("repair_candidate", "evaluate_candidate"),
]


def graph_mermaid() -> str:
    """The control graph as Mermaid text."""
    return "\n".join(["graph TD;", *(f"    {a} --> {b};" for a, b in GRAPH)]) + "\n"


def skipped_steps(plans: Column) -> Column:
    """Steps with a skip reason of all rounds' plans: (iteration, route_name, strategy, skip_reason)."""
    one = lambda p: F.transform(F.filter(p["steps"], lambda s: F.coalesce(s["skip_reason"], F.lit("")) != ""), lambda s: F.struct(p["iteration"].alias("iteration"), s["route_name"].alias("route_name"), s["strategy"].alias("strategy"), s["skip_reason"].alias("skip_reason")))
    return F.flatten(F.transform(plans, one))


def alternates(pool: list[str], current: Column) -> Column:
    """The parsers of a pool but the current one."""
    return F.array_except(F.array(*map(F.lit, pool)), F.array(current))


def output_folder(path: Column, folder: str) -> Column:
    """Below a folder named data the same path is kept, with a folder of the file's name; else all goes to one folder."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    nearest = F.regexp_extract(path, r"(?i)^(?:.*/)?data/((?:(?!data/)[^/]+/)*)[^/]+$", 1)
    below = path.rlike(r"(?i)(^|/)data/")
    return F.when(below, F.concat(F.lit(folder.rstrip("/") + "/"), nearest, stem)).otherwise(F.lit(folder))


def length_summary(payload: Column, texts: list[str]) -> Column:
    """A payload for traces: lengths in place of texts."""
    return F.struct(*(F.length(payload[t]).alias(f"{t}_chars") for t in texts))


def grid_of(rows: Column) -> Column:
    """Recovered rows as Markdown."""
    return G.markdown(F.transform(rows, lambda r: F.transform(r, normalized_cell)))
