"""Registered queries of visual planning: events become pages with table regions, answers and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import geometry as B
from quillspark.functions import labels as L
from quillspark.functions import text as T
from quillspark.plans import oracles as O
from quillspark.plans import visual as W
from quillspark.plans.queries import _LABELLED, _labelled, query, table
from quillspark.plans.rule_queries import _S, _X, mixed

def _e() -> Column:
    return F.col("event_id")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, regions: three tables on pages 1 and 2; the second is only referred to for even events."""

    def one(k: int):
        page, y = 1 + (_e() + k) % 2, (_e() * (k + 3)) % 5
        mode = F.when((_e() % 2 == 0) & F.lit(k == 1), "reference").otherwise("full")
        return F.struct(
            page.cast("int").alias("page"), F.lit(1.0 + k).alias("x0"), y.cast("double").alias("y0"), F.lit(9.0).alias("x1"), (y + 2).cast("double").alias("y1"), F.lit(f"t{k}").alias("table_id"), F.lit(None).cast("string").alias("label"),
            mode.alias("mode"), F.when((_e() % 7 == 0) & F.lit(k == 2), 1).cast("int").alias("continued_from"), F.lit(2).alias("rows"), F.lit(3).alias("columns")).cast(W.REGION)

    return table(spark, sf_dir, "events").select("event_id", F.array(*(one(k) for k in range(3))).alias("regions"))


_REGIONS = """r0 AS (SELECT event_id, unnest([0, 1, 2]) AS k FROM events),
r AS (SELECT event_id, k, (1 + (event_id + k) % 2)::INT AS page, ((event_id * (k + 3)) % 5)::DOUBLE AS y0, (1.0 + k)::DOUBLE AS x0, (event_id % 2 = 0 AND k = 1) OR (event_id % 7 = 0 AND k = 2) AS bad FROM r0),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id, page ORDER BY y0, x0) AS idx FROM r)"""
_NONE = "[]::VARCHAR[]"


@query(f"""WITH {_REGIONS} SELECT event_id, coalesce(list('t' || k ORDER BY idx) FILTER (WHERE page = 1), {_NONE}) AS first_page, count(*) FILTER (WHERE page = 1) > 1 AS ambiguous, bool_or(bad) AS html,
coalesce(list('visual-region-table-' || page || '-' || idx ORDER BY page, idx) FILTER (WHERE bad), {_NONE})[:2] AS tasks,
'[Table reference: id=t0 page=' || max(page) FILTER (WHERE k = 0) || ' bbox=1.0,' || max(y0) FILTER (WHERE k = 0) || ',9.0,' || (max(y0) FILTER (WHERE k = 0) + 2) || ' rows=2 cols=3]' AS reference FROM o GROUP BY event_id""")
def visual_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in the order of a page, tasks for troubled ones, their stand-in lines."""
    rows, r = _regions(spark, sf_dir), F.col("regions")
    issues = F.array(F.lit("missing_header"))
    html = W.prefers_html(issues, r, F.array(F.lit("markdown")))
    return rows.select(
        "event_id", F.transform(W.page_regions(F.lit(1), r), lambda x: x["table_id"]).alias("first_page"), W.ambiguous_page(F.lit(1), r).alias("ambiguous"), html.alias("html"),
        F.transform(W.region_tasks(r, issues, html, 2), lambda t: t["task_id"]).alias("tasks"), W.reference_line(F.get(r, F.lit(0))).alias("reference"))


_FINDING = "array<struct<table_label:string,page_number:int>>"


@query(f"""WITH {_REGIONS}, b AS (SELECT event_id, coalesce(list({{'page': page, 'idx': idx}} ORDER BY page, idx) FILTER (WHERE bad), []) AS bad, count(*) FILTER (WHERE page = 1) AS n1 FROM o GROUP BY event_id)
SELECT e.event_id, CASE WHEN e.event_id % 11 = 0 THEN '' WHEN e.event_id % 6 = 0 THEN 'visual-target-table-2-0:표 1-1' WHEN e.event_id % 6 = 1 THEN 'visual-structured-table-3-0:표 2-1,visual-structured-table-2-1:__page_table__:2'
WHEN e.event_id % 6 = 2 THEN 'visual-table-4-1:표 5-1' WHEN e.event_id % 6 = 3 THEN CASE WHEN n1 = 0 THEN 'visual-page-table-1-0:__page_table__:1' ELSE array_to_string(list_transform(range(1, n1 + 1), lambda i: 'visual-page-table-1-' || i || ':__page_table__:1:' || i), ',') END
ELSE array_to_string(list_transform(bad, lambda x: 'visual-region-table-' || x.page || '-' || x.idx || ':__page_table__:' || x.page || ':' || x.idx), ',') END AS tasks FROM events e JOIN b USING (event_id)""")
def visual_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by tier: routed targets, findings, named labels, named pages, troubled regions."""
    k = _e() % 6
    none = F.array().cast(_FINDING)
    found = lambda *xs: F.array(*(F.struct(F.lit(label).cast("string").alias("table_label"), F.lit(page).cast("int").alias("page_number")) for label, page in xs)).cast(_FINDING)
    pages = F.create_map(F.lit("표 2-1"), F.lit(3), F.lit("표 5-1"), F.lit(4))
    tasks = W.plan_tasks(
        F.lit(True), F.when(_e() % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("missing_header"))), F.when(k == 0, found(("표 1-1", 2))).otherwise(none),
        F.when(k == 1, found(("표 2-1", 99), (None, 2))).otherwise(none), F.when(k == 2, F.array(F.lit("표 9-9"), F.lit("표 5-1"))).otherwise(F.array().cast("array<string>")), F.when(k == 3, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        F.lit(0.5), F.col("regions"), pages, F.lit(5), F.array(F.lit("markdown")))
    return _regions(spark, sf_dir).select("event_id", F.array_join(F.transform(tasks, lambda t: F.concat(t["task_id"], F.lit(":"), t["table_label"])), ",").alias("tasks"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '표 1-1' WHEN 1 THEN '표 9-9' ELSE '표 7-7' END AS table_label, CASE event_id % 4 WHEN 0 THEN 6 ELSE 2 END AS page_number, CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.7 END::DOUBLE AS confidence,
CASE event_id % 4 WHEN 0 THEN '| a 1.5 | ㎢ |' WHEN 1 THEN 'x' WHEN 2 THEN '| a | b |' || chr(10) || '| --- | --- |' ELSE NULL END AS markdown,
CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'content_mismatch' END WHEN 1 THEN 'sanity_check_failed' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'patch_target_not_found' END ELSE 'empty_recovery' END AS rejected FROM events""")
def recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON with and without the usual fields, as bare tables, and unreadable; and why they are rejected."""
    k = _e() % 4
    answer = (
        F.when(k == 0, '{"table_label": "표 1-1", "page_number": 6, "confidence": 0.5, "markdown": "| a 1,5<br>![i](x.png) | <b>km²</b> |"}').when(k == 1, '```json\n{"table_label": "표 9-9", "html": "x"}\n```')
        .when(k == 2, "here:\n| a | b |\n| --- | --- |\nend").otherwise("no table")
    )
    r = W.recovery(answer, F.lit("표 7-7"), F.lit(2))
    rows = table(spark, sf_dir, "events").select("event_id", r.alias("r"))
    why = W.rejection(True, F.col("r.page_number"), F.lit(9), F.lit(None).cast("string"), F.col("r.markdown"), F.col("r.confidence"), F.when(_e() % 8 == 0, 0.2), k != 1, ~((k == 2) & (_e() % 3 == 0)))
    clean = F.regexp_replace(W.normalized_markup(F.col("r.markdown")), r" +", " ")
    return rows.select("event_id", "r.table_label", "r.page_number", "r.confidence", clean.alias("markdown"), why.alias("rejected"))


_MARK = O.matches(_S, T.PAGE_MARKER)


@query(f"""{_X}, p AS (SELECT order_id, text, ls, list_position(list_transform(ls, lambda x: {_S}), '<!-- page 3 -->') AS start FROM x),
q AS (SELECT *, CASE WHEN start > 0 THEN ls[start + 1:] ELSE [] END AS rest FROM p),
s AS (SELECT *, list_position(list_transform(rest, lambda x: {_MARK}), true) AS stop, list_position(list_transform(ls, lambda x: contains(x, '3-1')), true) AS pos FROM q)
SELECT order_id, CASE WHEN stop > 0 THEN rest[:stop - 1] ELSE rest END AS section, CASE WHEN pos > 0 THEN {O.strip("array_to_string(ls[pos:pos + 13], chr(10))")} ELSE '' END AS excerpt,
{O.matches("text", L.JUDGED)} OR contains(lower(text), '<table') OR {O.count_if("ls", f"({O.count(_S, '|')} >= 2 AND (starts_with({_S}, '|') OR ends_with({_S}, '|')))")} >= 2 AS table_cues FROM s""")
def page_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page, lines from a label on, and whether a text speaks of tables."""
    t = F.col("text")
    return mixed(spark, sf_dir).select("order_id", W.page_section(t, F.lit(3)).alias("section"), W.label_excerpt(t, F.lit("표 3-1")).alias("excerpt"), W.has_table_cues(t).alias("table_cues"))


@query(f"""WITH l AS ({_LABELLED}), u0 AS (SELECT order_id, unnest(regexp_extract_all(text, {O.lit(L.JUDGED)}, 1)) AS label, generate_subscripts(regexp_extract_all(text, {O.lit(L.JUDGED)}, 1), 1) AS i FROM l),
u AS (SELECT order_id, label, min(i) AS i FROM u0 GROUP BY order_id, label), d AS (SELECT order_id, list(label ORDER BY i) AS ls FROM u GROUP BY order_id)
SELECT order_id, CASE WHEN len(ls) <= 3 THEN ls ELSE [ls[1], ls[round_even((len(ls) - 1) / 2.0, 0)::INT + 1], ls[-1]] END AS labels FROM d""")
def selected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labels, evenly spaced."""
    return _labelled(spark, sf_dir).select("order_id", W.selected_labels(F.col("text"), F.lit(""), 3).alias("labels"))


@query("""SELECT event_id, list_sort(map_entries(CASE WHEN event_id % 2 = 0 THEN MAP {'a': 1, 'b': 2, 'c': 3} ELSE MAP {'b': 2, 'c': 3} END)) AS pages, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 5 END AS position_page,
CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_first, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS n_all, CASE WHEN event_id % 4 > 0 THEN 'html' ELSE 'markdown' END AS table_format,
CASE WHEN event_id % 5 = 1 THEN 1 WHEN event_id % 5 = 2 THEN 7 WHEN event_id % 5 = 3 THEN 3 END AS resolved FROM events""")
def metadata_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several parsers tell of one document: the first view wins."""
    text = lambda **kv: F.create_map(*(F.lit(x) for pair in kv.items() for x in pair))
    none = F.create_map().cast("map<string,string>")
    pages = W.label_pages(F.when(_e() % 2 == 0, text(a="1", b="x")).otherwise(none), F.array(F.when(_e() % 2 == 0, text(a="9", b="2")).otherwise(text(b="2")), text(c="3", b="8")))
    place = lambda p: F.create_map(F.lit("t"), F.struct(p.cast("int").alias("page"), F.lit(1).alias("region_index"), F.lit(0).alias("global_index")))
    positions = W.label_positions(place(F.when(_e() % 3 == 0, 4)), F.array(place(F.lit(5))))
    region = F.struct(*(F.lit(1).cast(kind).alias(n) for n, kind in (x.split(":") for x in W.REGION[7:-1].split(",")))).cast(W.REGION)
    own = F.when(_e() % 2 == 0, F.array(region, region)).otherwise(F.array().cast(f"array<{W.REGION}>"))
    others = F.array(F.array(region))
    merged = W.merged_metadata(own, F.array(region), text(a="1"), text(a="2"), F.when(_e() % 4 == 0, "markdown"), F.lit("html"))
    label = F.when(_e() % 5 == 1, "a").when(_e() % 5 == 2, "__page_table__:7:1").when(_e() % 5 == 3, "z").otherwise("none")
    found = W.finding_page(label, F.when(_e() % 5 == 3, 3).when(_e() % 5 == 4, 9), F.create_map(F.lit("a"), F.lit(1)), F.lit(5))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_sort(F.map_entries(pages)).alias("pages"), F.try_element_at(positions, F.lit("t"))["page"].alias("position_page"), F.size(W.first_regions(own, others)).cast("long").alias("n_first"),
        F.size(W.all_regions(own, others)).cast("long").alias("n_all"), merged["table_format"].alias("table_format"), found.alias("resolved"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '0:1x2,2:1x1,3:1x1' ELSE '0:2x1,1:1x1,3:1x1' END AS spans, CASE WHEN event_id % 3 = 0 THEN 'two words' || chr(10) || 'below' ELSE 'raw text of the block' END AS text FROM events""")
def cells_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of cells with equal boxes; a block's text from the words in it."""
    box = lambda *c: B.box(*(F.lit(float(x)) for x in c))
    wide, tall = box(0, 0, 2, 1), box(0, 0, 1, 2)
    cells = F.when(_e() % 2 == 0, F.array(wide, wide, box(0, 1, 1, 2), box(1, 1, 2, 2))).otherwise(F.array(tall, box(1, 0, 2, 1), tall, box(1, 1, 2, 2)))
    spans = F.array_sort(F.map_entries(W.cell_spans(cells, F.lit(2), F.lit(2))))
    word = lambda x, y, t, line, n: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x + 1)).alias("x1"), F.lit(float(y + 1)).alias("y1"), F.lit(t).alias("text"), F.lit(line).alias("line"), F.lit(n).alias("word"))
    words = F.array(word(1, 0, "words", 0, 1), word(0, 0, "two", 0, 0), word(0, 1, "below", 1, 0), word(50, 50, "outside", 2, 0))
    raw = F.when(_e() % 3 == 0, "two words below").otherwise("raw text of the block")
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(F.transform(spans, lambda s: F.concat(s["key"].cast("string"), F.lit(":"), s["value"]["rows"].cast("string"), F.lit("x"), s["value"]["columns"].cast("string"))), ",").alias("spans"),
        W.text_from_words(words, box(0, 0, 10, 10), raw).alias("text"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['a', 'b', 'a'] WHEN 1 THEN ['a'] ELSE [] END AS neighbours, event_id % 5 <> 1 AS retryable, CASE WHEN event_id % 2 = 0 THEN '1:r2,2:r1' ELSE '2:r1' END AS skipped,
list_filter(['one', 'two', 'three'], lambda x: x <> CASE WHEN event_id % 2 = 0 THEN 'two' ELSE 'none' END) AS alternates, CASE event_id % 3 WHEN 0 THEN '/out/sub/name' WHEN 1 THEN '/out' ELSE '/out/name' END AS folder,
CASE WHEN event_id % 2 = 0 THEN 'a<br>b c' ELSE 'x' END AS cell, 5::BIGINT AS n_chars FROM events""")
def workflow_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.when(_e() % 3 == 0, F.array(*map(F.lit, "aabbba"))).when(_e() % 3 == 1, F.array(*map(F.lit, "aaa"))).otherwise(F.array().cast("array<string>"))
    status = F.when(_e() % 5 == 0, 429).when(_e() % 5 == 1, 404).when(_e() % 5 == 2, 503).when(_e() % 5 == 3, 408)
    step = lambda route, why: F.struct(F.lit(route).alias("route_name"), F.lit("heuristic").alias("strategy"), why.cast("string").alias("skip_reason"))
    plans = F.array(F.struct(F.lit(1).alias("iteration"), F.array(step("r1", F.lit(None)), step("r2", F.when(_e() % 2 == 0, "stalled").otherwise(""))).alias("steps")), F.struct(F.lit(2).alias("iteration"), F.array(step("r1", F.lit("cost"))).alias("steps")))
    path = F.when(_e() % 3 == 0, "/in/data/sub/name.pdf").when(_e() % 3 == 1, "/in/other/name.pdf").otherwise("/in/Data/name.pdf")
    return table(spark, sf_dir, "events").select(
        "event_id", W.distinct_neighbours(items).alias("neighbours"), W.retryable(status).alias("retryable"), F.array_join(F.transform(W.skipped_steps(plans), lambda s: F.concat(s["iteration"].cast("string"), F.lit(":"), s["route_name"])), ",").alias("skipped"),
        W.alternates(["one", "two", "three"], F.when(_e() % 2 == 0, "two").otherwise("none")).alias("alternates"), W.output_folder(path, "/out").alias("folder"), W.normalized_cell(F.when(_e() % 2 == 0, " a \n b  c").otherwise("x")).alias("cell"),
        W.length_summary(F.struct(F.lit("12345").alias("text")), ["text"])["text_chars"].cast("long").alias("n_chars"))
