"""Registered queries of single rules: predicates and counts of lines, evaluation by class, directives, repairs.

Orders become texts of many kinds of lines (``mixed``), texts with numbered sections
(``cued``) and tables with uneven rows (``ragged``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions import text as T
from quillspark.operators import line_repair as R
from quillspark.operators import metrics as M
from quillspark.operators import recovery as V
from quillspark.plans import oracles as O
from quillspark.plans import planner as P
from quillspark.plans.queries import DOC, _D, _M, _SW, _talk_pairs, damaged, grids, query, table

#: Lines of ``mixed``; {n} is a number of the line item.
LINES = [
    "# Heading {n}", "- item {n}", "| a | {n} |", "| --- | :-: |", "name: value {n}", "{n}. Section words", "표 {n}-1 values", "left part  {n} words", "![i](x{n}.png) | b", "a line that was", "wrapped behind it {n}",
    "({n}) paren item", "<!-- page {n} -->", "- {n} -", "Short head", "", "a | b | {n} | c", "<table><tr><td>{n}</td></tr></table>", "## heading {n}", "1 2 3 numbers {n}", "Ends with colon:",
    "한국어로 된 아주 길고 끝나지 않는 문장이 여기에서 이렇게 끊어졌고", "이어지는 문장 {n} 입니다.", "  padded line  ",
]


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, text: a line for each item of the order, its kind by part."""
    n = F.col("l_linenumber").cast("string")
    line = F.replace(F.get(F.array(*map(F.lit, LINES)), F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(len(LINES))).cast("int")), F.lit("{n}"), n)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("t")))).alias("r"))
    return rows.select("order_id", F.array_join(F.transform("r", lambda s: s["t"]), "\n").alias("text"))


_X = f"""WITH x0 AS (SELECT l_orderkey AS order_id, string_agg(replace([{", ".join(map(O.lit, LINES))}][((l_partkey + l_suppkey) % {len(LINES)})::INT + 1], '{{n}}', l_linenumber::VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY l_orderkey),
x AS (SELECT order_id, text, CASE WHEN text = '' THEN [] ELSE {O.lines("text")} END AS ls FROM x0)"""
_S = O.strip("x")
_TAIL = f"(starts_with({_S}, '|') OR ends_with({_S}, '|'))"
_CELLS = f"list_transform(string_split(regexp_replace({_S}, '^\\||\\|$', '', 'g'), '|'), lambda c: {O.strip('c')})"
_KV = T.KEY_VALUE
_KEY_VALUE = f"(NOT contains(x, '|') AND {O.matches('x', _KV)} AND {O.strip(f'regexp_extract(x, {O.lit(_KV)}, 1)')} <> '' AND {O.strip(f'regexp_extract(x, {O.lit(_KV)}, 2)')} <> '' AND ({O.n_fields(O.strip(f'regexp_extract(x, {O.lit(_KV)}, 2)'))} <= 12 OR regexp_matches(regexp_extract(x, {O.lit(_KV)}, 2), '[0-9]')))"
_NUMBERS = f"len(regexp_extract_all(x, {O.lit(T.NUMBER)}))"

#: Predicate by name: over a line, and in SQL over x.
LINE_TESTS = {
    "non_empty": (lambda x: ~T.blank(x), f"NOT {O.blank('x')}"),
    "headings": (lambda x: T.kind(x) == "heading", f"{O.kind('x')} = 'heading'"),
    "list_items": (lambda x: T.kind(x) == "list", f"{O.kind('x')} = 'list'"),
    "table_lines": (T.table_line, O.table_line("x")),
    "separators": (T.separator_line, f"({O.table_line('x')} AND len(list_filter({_CELLS}, lambda c: NOT regexp_matches(c, '^[:-]+$'))) = 0)"),
    "strict_rows": (T.strict_row, f"(starts_with({_S}, '|') AND ends_with({_S}, '|'))"),
    "full_rows": (T.full_row, f"(starts_with({_S}, '|') AND ends_with({_S}, '|') AND {O.count(_S, '|')} >= 2)"),
    "open_rows": (T.open_row, f"starts_with({_S}, '|')"),
    "markdown_rows": (T.markdown_row, f"({O.count(_S, '|')} >= 2 AND {_TAIL})"),
    "barred": (T.any_bar, "contains(x, '|')"),
    "numeric_rows": (T.numeric_row, f"(NOT {O.blank('x')} AND ({_NUMBERS} >= 2 OR ({_NUMBERS} >= 1 AND len({O.words('x')}) >= 4)))"),
    "structured": (T.structured_source, O.structured_source("x")),
    "structural": (T.structural, O.structural("x")),
    "corrupted": (T.corrupted_row, f"(contains({_S}, '|') AND ({O.matches(_S, T.IMAGE)} OR ({O.count(_S, '|')} >= 2 AND NOT {_TAIL})))"),
    "key_values": (T.key_value, _KEY_VALUE),
    "boundaries": (T.boundary, O.boundary("x")),
    "boundary_headings": (T.boundary_heading, f"({O.matches(_S, T.SECTION)} OR {O.matches(_S, T.LIST_ITEM)} OR {O.matches(_S, T.CAPTION)})"),
    "captions": (V.caption, f"({O.structured_source('x')} AND {O.matches(_S, T.CAPTION)})"),
    "page_markers": (lambda x: T.strip(x).rlike(T.PAGE_MARKER), O.matches(_S, T.PAGE_MARKER)),
    "page_footers": (lambda x: T.strip(x).rlike(T.PAGE_FOOTER), O.matches(_S, T.PAGE_FOOTER)),
}


@query(f"""{_X} SELECT order_id, {", ".join(f"{O.count_if('ls', sql)}::BIGINT AS {name}" for name, (_, sql) in LINE_TESTS.items())} FROM x""")
def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a text pass each predicate."""
    rows = mixed(spark, sf_dir).select("order_id", T.lines(F.col("text")).alias("ls"))
    n = lambda test: F.size(F.filter("ls", lambda x: F.coalesce(test(x), F.lit(False)))).cast("long")
    return rows.select("order_id", *(n(test).alias(name) for name, (test, _) in LINE_TESTS.items()))


_HEADS = f"list_filter(list_transform(ls, lambda x: CASE WHEN {O.matches('x', T.HEADING)} THEN lower({O.strip(f'regexp_extract(x, {O.lit(T.HEADING)}, 1)')}) END), lambda h: h IS NOT NULL)"
_PAIRS = "list_transform(range(1, len(ls)), lambda i: {a: ls[i], b: ls[i + 1]})".replace("{a", "{'a'").replace(", b:", ", 'b':")
_MERGE = O.merges("p.a", "p.b")
_KV_PAIR = f"{_KEY_VALUE.replace('(x,', '(p.a,').replace('x,', 'p.a,')} "


def _kv(of: str) -> str:
    value = O.strip(f"regexp_extract({of}, {O.lit(_KV)}, 2)")
    return f"(NOT contains({of}, '|') AND {O.matches(of, _KV)} AND {O.strip(f'regexp_extract({of}, {O.lit(_KV)}, 1)')} <> '' AND {value} <> '' AND ({O.n_fields(value)} <= 12 OR regexp_matches({value}, '[0-9]')))"


@query(f"""{_X} SELECT order_id, len({_HEADS}) > len(list_distinct({_HEADS})) AS duplicate_headings, {O.count_if("ls", LINE_TESTS["corrupted"][1])} > 0 AS layout_noise, {O.matches("text", T.IMAGE)} AS images,
len(list_filter({_PAIRS}, lambda p: {_MERGE})) > 0 AS wrapped, len(list_filter({_PAIRS}, lambda p: {_kv("p.a")} AND {_kv("p.b")})) > 0 AS key_value_run FROM x""")
def text_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts hold each kind of noise."""
    t = F.col("text")
    tests = {"duplicate_headings": R.has_duplicate_headings, "layout_noise": R.has_layout_noise, "images": R.has_images, "wrapped": R.has_wrapped_lines, "key_value_run": R.has_key_value_run}
    return mixed(spark, sf_dir).select("order_id", *(F.coalesce(f(t), F.lit(False)).alias(name) for name, f in tests.items()))


def _first(test: str) -> str:
    return f"(list_filter(list_transform(ls, lambda x, i: CASE WHEN {test} THEN i - 1 END), lambda i: i IS NOT NULL)[1])::BIGINT"


@query(f"""{_X} SELECT order_id, {_first(LINE_TESTS["corrupted"][1])} AS corrupted, (list_filter(list_transform({_PAIRS}, lambda p, i: CASE WHEN {_MERGE} THEN i - 1 END), lambda i: i IS NOT NULL)[1])::BIGINT AS wrapped,
{_first(f"length({O.norm('x')}) > 5 AND len(list_filter(ls[:i - 1], lambda y: {O.norm('y')} = {O.norm('x')})) > 0")} AS duplicate, {_first(f"i + 1 <= len(ls) AND {O.blank('x')} AND {O.blank('ls[i + 1]')} AND NOT (i > 1 AND {O.blank('ls[i - 1]')})")} AS blank_run FROM x""")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first line with each kind of noise stands."""
    t = F.col("text")
    found = {"corrupted": R.first_corrupted_row(t), "wrapped": R.first_wrapped_line(t), "duplicate": R.first_duplicate_line(t), "blank_run": R.first_blank_run(t, 2)}
    return mixed(spark, sf_dir).select("order_id", *(c.cast("long").alias(name) for name, c in found.items()))


@query(f"""{_X}, k AS (SELECT *, CASE WHEN len(ls) > 2 THEN 2 ELSE 0 END AS anchor FROM x)
SELECT order_id, greatest(0, anchor - 2)::BIGINT AS start, least(len(ls), anchor + 3)::BIGINT AS end_line, array_to_string(ls[greatest(0, anchor - 2) + 1:least(len(ls), anchor + 3)], chr(10)) AS text FROM k""")
def issue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around an anchor."""
    t = F.col("text")
    w = mixed(spark, sf_dir).select("order_id", R.issue_window(t, F.when(F.size(T.lines(t)) > 2, 2).otherwise(0), 5).alias("w"))
    return w.select("order_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end_line"), F.col("w.text").alias("text"))


@query(f"""{_X}, m AS (SELECT order_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM x),
p AS (SELECT *, max(CASE WHEN {O.matches(O.strip("l"), T.PAGE_MARKER)} THEN i END) OVER (PARTITION BY order_id ORDER BY i) AS mark FROM m)
SELECT order_id, (i - 1)::BIGINT AS line_no, CASE WHEN mark IS NOT NULL THEN regexp_extract(list_extract(ls, mark), '([0-9]+)', 1)::BIGINT END AS page FROM p JOIN x USING (order_id)""")
def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.page_ids(M.exploded(mixed(spark, sf_dir), ["order_id"], "text"), ["order_id"])
    return rows.select("order_id", F.col("line_no").cast("long").alias("line_no"), F.col("page").cast("long").alias("page"))


@query(f"""{_X}, m AS (SELECT order_id, len(ls) AS n, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM x),
p AS (SELECT * FROM m WHERE {O.matches(O.strip("l"), T.PAGE_MARKER)})
SELECT order_id, regexp_extract(l, '([0-9]+)', 1)::BIGINT AS page, i::BIGINT AS start, coalesce(lead(i) OVER (PARTITION BY order_id ORDER BY i), n)::BIGINT AS end_line FROM p""")
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.page_segments(M.exploded(mixed(spark, sf_dir), ["order_id"], "text"), ["order_id"])
    return rows.select("order_id", *(F.col(c).cast("long").alias(a) for c, a in (("page", "page"), ("start", "start"), ("end", "end_line"))))


_IMAGE = O.lit(T.IMAGE)


@query(f"""{_X} SELECT order_id, array_to_string(list_transform(list_filter(ls, lambda x: NOT regexp_full_match({_S}, {_IMAGE})), lambda x: regexp_replace(regexp_replace(regexp_replace(x, {_IMAGE}, '', 'g'), '\\s{{2,}}', ' ', 'g'), '\\s+$', '')), chr(10)) AS without_images,
array_to_string(list_transform(ls, lambda x: CASE WHEN {O.count("x", "|")} >= 2 THEN '| ' || array_to_string(list_transform(string_split(regexp_replace({O.strip(f"regexp_replace(x, {_IMAGE}, '', 'g')")}, '^\\||\\|$', '', 'g'), '|'), lambda c: {O.strip("c")}), ' | ') || ' |' ELSE x END), chr(10)) AS table_layout FROM x""")
def line_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without image links; with table rows written anew."""
    t = F.col("text")
    plain = lambda c: T.join_lines(T.lines(c))
    return mixed(spark, sf_dir).select("order_id", plain(R.strip_images(t)).alias("without_images"), plain(R.normalize_table_layout(t)).alias("table_layout"))


_NORM = O.norm("x")


@query(f"""{_X} SELECT order_id, list_sort(list_distinct(list_filter(list_transform(ls, lambda x: {_NORM}), lambda n: n <> ''))) AS normalized, list_transform(ls, lambda x: replace({O.collapse("x")}, ' ', '')) AS compacted FROM x""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = T.lines(F.col("text"))
    distinct = F.array_sort(F.array_distinct(F.filter(F.transform(ls, T.normalize), lambda x: x != "")))
    return mixed(spark, sf_dir).select("order_id", distinct.alias("normalized"), F.transform(ls, T.compact).alias("compacted"))


# Evaluation by class


def cued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, source, candidate: numbered sections, of which the candidate lost every third line."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    line = F.when(n % 3 == 1, F.concat(F.lit("제 "), n.cast("string"), F.lit(" 장"))).when(n % 3 == 2, F.concat((1 + p % 20).cast("string"), F.lit("."), (p % 10).cast("string"), F.lit(" Title"))).otherwise("plain words")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t")))).alias("r"))
    ls = F.transform("r", lambda s: s["t"])
    return rows.select("order_id", F.array_join(ls, "\n").alias("source"), F.array_join(F.filter(ls, lambda x, i: i % 3 != 1), "\n").alias("candidate"))


_CUED = """c0 AS (SELECT l_orderkey AS order_id, list(CASE l_linenumber % 3 WHEN 1 THEN '제 ' || l_linenumber::VARCHAR || ' 장' WHEN 2 THEN (1 + l_partkey % 20)::VARCHAR || '.' || (l_partkey % 10)::VARCHAR || ' Title' ELSE 'plain words' END ORDER BY l_linenumber, l_partkey) AS sl FROM lineitem GROUP BY l_orderkey),
c AS (SELECT order_id, sl, list_filter(sl, lambda x, i: (i - 1) % 3 <> 1) AS cl FROM c0),
q AS (SELECT order_id, sl, cl, list_filter(sl, lambda x: x <> 'plain words') AS sc, list_filter(cl, lambda x: x <> 'plain words') AS cc FROM c),
n AS (SELECT *, list_sum(list_transform(list_distinct(sc), lambda x: least(len(list_filter(sc, lambda y: y = x)), len(list_filter(cc, lambda y: y = x))))) AS hit FROM q)"""


@query(f"WITH {_CUED} SELECT order_id, CASE WHEN len(sc) > 0 THEN hit::DOUBLE / len(sc) END AS cue_coverage FROM n")
def pdf_cue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cue_coverage(cued(spark, sf_dir), ["order_id"], "source", "candidate")


def _token_share(s: str, c: str) -> str:
    """Multiset share of the tokens of list s in list c."""
    return f"CASE WHEN len({s}) = 0 THEN 1.0 ELSE list_sum(list_transform(list_distinct({s}), lambda t: least(len(list_filter({s}, lambda y: y = t)), len(list_filter({c}, lambda y: y = t)))))::DOUBLE / len({s}) END"


_SCORES = ["text_coverage", "structure_retention", "table_preservation", "table_consistency", "empty_block_penalty", "repetition_penalty"]


def _rep(ls: str) -> str:
    return f"(CASE WHEN len({ls}) = 0 THEN 0.0 ELSE (len({ls}) - len(list_distinct(list_transform({ls}, lambda x: lower(x)))))::DOUBLE / len({ls}) END)::DOUBLE"


@query(f"""WITH {_CUED}, w AS (SELECT *, {O.words("array_to_string(sl, ' ')")} AS sw, {O.words("array_to_string(cl, ' ')")} AS cw FROM n)
SELECT order_id, ({_token_share("sw", "cw")})::DOUBLE AS text_coverage, (CASE WHEN len(sc) > 0 THEN hit::DOUBLE / len(sc) ELSE ({O.count_similarity("len(sl)", "len(cl)")} + {O.count_similarity("1", "CASE WHEN len(cl) > 0 THEN 1 ELSE 0 END")}) / 2 END)::DOUBLE AS structure_retention,
1.0::DOUBLE AS table_preservation, 1.0::DOUBLE AS table_consistency, 0.0::DOUBLE AS empty_block_penalty, {_rep("cl")} AS repetition_penalty FROM w""")
def evaluation_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of PDF sources but those of sequences."""
    return M.evaluate(cued(spark, sf_dir), ["order_id"], similarity=F.lit(None).cast("double"), source_class="pdf").select("order_id", *_SCORES)


_HEADER = ["line", "part", "quantity", "flag"]


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, source (rows as plain text), candidate (a table whose every third row lost its last cell, beside one in HTML)."""
    from quillspark.functions import grids as G

    body = F.transform("a", lambda r, i: F.when((i + 1) % 3 == 0, F.slice(r, 1, 3)).otherwise(r))
    rows = F.transform(F.concat(F.array(F.array(*map(F.lit, _HEADER)), F.array_repeat(F.lit("---"), 4)), body), G.row_markdown)
    markdown = F.concat(F.array_join(rows, "\n"), F.lit("\n\n<table><tr><td>x</td></tr></table>\n\nend"))
    return grids(spark, sf_dir).select("order_id", F.concat(F.lit("line part quantity flag\n"), F.array_join(F.transform("a", lambda r: F.array_join(r, " ")), "\n")).alias("source"), markdown.alias("candidate"))


_R = f"""WITH {O.GRIDS}, r AS (SELECT order_id, a, (2 + len(list_filter(a, lambda r, i: i % 3 <> 0)))::DOUBLE / (2 + len(a)) AS c,
regexp_extract_all(lower('line part quantity flag ' || array_to_string(list_transform(a, lambda r: array_to_string(r, ' ')), ' ')), {O.lit(T.WORD)}) AS sw,
regexp_extract_all(lower('line part quantity flag ' || array_to_string(list_transform(a, lambda r, i: array_to_string(CASE WHEN i % 3 = 0 THEN r[1:3] ELSE r END, ' ')), ' ') || ' table tr td x td tr table end'), {O.lit(T.WORD)}) AS cw FROM g)"""


@query(f"{_R} SELECT order_id, c::DOUBLE AS table_consistency FROM r")
def table_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table_consistency(ragged(spark, sf_dir), ["order_id"], "candidate")


@query(f"""{_R} SELECT order_id, ({_token_share("sw", "cw")})::DOUBLE AS text_coverage, 1.0::DOUBLE AS structure_retention, (CASE WHEN c < 1 THEN 1.0::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * c) ELSE 1.0 END)::DOUBLE AS table_preservation,
c::DOUBLE AS table_consistency, 0.0::DOUBLE AS empty_block_penalty, {_rep("list_concat(['a', 'b'], list_concat(list_transform(a, lambda r, i: array_to_string(CASE WHEN i % 3 = 0 THEN r[1:3] ELSE r END, ' ')), ['c', 'd']))")} AS repetition_penalty FROM r""")
def evaluation_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of structured sources but those of sequences."""
    return M.evaluate(ragged(spark, sf_dir), ["order_id"], similarity=F.lit(None).cast("double"), source_class="structured").select("order_id", *_SCORES)


_KINDS_E = ", ".join(f"{O.count_if('sl', O.kind('x') + f' = {O.lit(k)}')} AS e_{k}, {O.count_if('cl', O.kind('x') + f' = {O.lit(k)}')} AS a_{k}" for k in M.KINDS)
_MARKED = "(" + " + ".join(f"(e_{k} > 0)::INT" for k in M.KINDS) + ")"
_STRUCTURE = f"""(CASE WHEN {O.blank("source")} THEN (CASE WHEN {O.blank("candidate")} THEN 1.0 ELSE 0.0 END) WHEN {_MARKED} > 0 THEN {O.clamp("(" + " + ".join(f"CASE WHEN e_{k} > 0 THEN {O.count_similarity(f'e_{k}', f'a_{k}')} ELSE 0.0 END" for k in M.KINDS) + f") / {_MARKED}")}
ELSE ({O.count_similarity("fe", "fa")} + {O.count_similarity("pe", "pa")}) / 2 END)::DOUBLE"""


def _paragraphs(e: str) -> str:
    return rf"len(list_filter(string_split_regex({O.strip(e)}, '\n\s*\n'), lambda x: NOT {O.blank('x')}))"


_E = f"""{_M}, s AS (SELECT doc_id, source, candidate, {_KINDS_E}, {O.count_if("sl", f"NOT {O.blank('x')}")} AS fe, {O.count_if("cl", f"NOT {O.blank('x')}")} AS fa, {_paragraphs("source")} AS pe, {_paragraphs("candidate")} AS pa FROM d),
v AS (SELECT z.doc_id, cov, tab, blank, rep, {_STRUCTURE} AS struct FROM z JOIN s USING (doc_id))"""


@query(f"{_E} SELECT doc_id, cov AS text_coverage, struct AS structure_retention, tab AS table_preservation, blank AS empty_block_penalty, rep AS repetition_penalty FROM v")
def evaluation_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of plain sources but those of sequences."""
    out = M.evaluate(damaged(spark, sf_dir), DOC, similarity=F.lit(None).cast("double"))
    return out.select("doc_id", *(c for c in _SCORES if c != "table_consistency"))


_UNDECORATED = f"list_filter(list_transform(cl, lambda x: CASE WHEN {O.table_line('x')} THEN array_to_string(list_filter({_CELLS}, lambda c: c <> ''), ' ') ELSE regexp_replace(regexp_replace(regexp_replace(x, '^\\s{{0,3}}#{{1,6}}\\s+', ''), '^\\s*[-*+]\\s+', ''), '\\*\\*([^*]+)\\*\\*', '\\1', 'g') END), lambda x: x IS NOT NULL)"
_PK = ", ".join(f"{O.count_if('ls', O.kind('x') + f' = {O.lit(k)}')} AS e_{k}, {O.count_if('ul', O.kind('x') + f' = {O.lit(k)}')} AS a_{k}" for k in M.KINDS)


@query(f"""WITH {O.TALKS}, s0 AS (SELECT conv_id, ls, list_filter(ls, lambda x, i: (i - 1) % 6 <> 1) AS cl FROM t), s1 AS (SELECT conv_id, ls, {_UNDECORATED} AS ul FROM s0), s2 AS (SELECT conv_id, {_PK} FROM s1)
SELECT conv_id, {O.clamp("(" + " + ".join(f"CASE WHEN e_{k} > 0 THEN {O.count_similarity(f'e_{k}', f'a_{k}')} ELSE 0.0 END" for k in M.KINDS) + f") / {_MARKED}")}::DOUBLE AS structured_structure FROM s2""")
def structured_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk_pairs(spark, sf_dir).select("conv_id", M.structured_structure(F.col("text"), F.col("candidate")).alias("structured_structure"))


# Directives and repairs

_LOST = f"{O.structured_source('x')} AND n <> '' AND there IS NULL AND (p IS NOT NULL OR q IS NOT NULL)"
_HEADED = f"""list_filter(list_transform(cl, lambda x: CASE WHEN {O.matches("x", T.HEADING)} THEN lower({O.strip(f"regexp_extract(x, {O.lit(T.HEADING)}, 1)")}) END), lambda h: h IS NOT NULL)"""
_DP = "list_transform(range(1, len(cl)), lambda i: {'a': cl[i], 'b': cl[i + 1]})"
_RULES = f"""{_E}, lost AS (SELECT doc_id, true AS lines, bool_or({O.matches(O.strip("x"), T.CAPTION)}) AS captions FROM ({_SW.replace(_D + ",", "WITH", 1)} SELECT * FROM w WHERE {_LOST}) GROUP BY doc_id),
f AS (SELECT d.doc_id, d.doc_id % 2 = 0 AS pdf, coalesce(lines, false) AS lines, coalesce(captions, false) AS captions, {O.matches("candidate", T.IMAGE)} AS images, {O.count_if("cl", LINE_TESTS["corrupted"][1])} > 0 AS noise,
  len({_HEADED}) > len(list_distinct({_HEADED})) AS heads, coalesce(len(list_filter({_DP}, lambda p: {_MERGE})) > 0, false) AS wrapped, coalesce(len(list_filter({_DP}, lambda p: {_kv("p.a")} AND {_kv("p.b")})) > 0, false) AS pairs
  FROM d LEFT JOIN lost USING (doc_id))"""
_WHEN = {
    "image_link_noise": "images", "missing_table_caption": "captions", "text_coverage_missing_paragraphs": "pdf AND cov < 0.9::DOUBLE", "table_cross_parser_fusion": "pdf AND tab < 0.75::DOUBLE", "text_coverage_missing_lines": "cov < 0.72::DOUBLE AND lines",
    "table_layout_noise": "tab < 0.75::DOUBLE OR noise", "table_text_block_recovery": "tab < 0.75::DOUBLE AND pairs", "structure_toc_headings": "pdf AND struct < 0.75::DOUBLE", "structure_heading_noise": "struct < 0.75::DOUBLE OR heads",
    "blank_line_noise": "blank > 0", "boundary_repetition_noise": "rep > 0", "line_repetition_noise": "rep > 0", "wrapped_line_noise": "wrapped",
}


@query(f"""{_RULES} SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {w} THEN '{k}' END" for k, w in _WHEN.items())}], lambda x: x IS NOT NULL), ',') AS directives FROM v JOIN f USING (doc_id)""")
def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives from metrics and texts; even documents count as PDFs.  The two that a fold decides are tested apart.

    No rule asks for the similarity of sequences, so it is not computed.
    """
    rows = P.flagged(M.evaluate(damaged(spark, sf_dir), DOC, similarity=F.lit(None).cast("double")).withColumn("content", F.col("candidate")), DOC)
    fired = P.directives(P.inputs(rows, is_pdf=F.col("doc_id") % 2 == 0, page_edges=F.lit(False), boundaries_change=F.lit(False)))
    return rows.select("doc_id", F.array_join(F.transform(fired, lambda x: x["issue_type"]), ",").alias("directives"))


_BESIDE = f"(i = 1 OR i = len(cl) OR {O.blank('cl[i - 1]')} OR {O.blank('cl[i + 1]')})"


@query(f"""{_D}, e AS (SELECT doc_id, unnest(cl) AS x, generate_subscripts(cl, 1) AS i, cl FROM d),
b AS (SELECT doc_id, lower({O.strip("x")}) AS n FROM e WHERE {O.boundary("x")} AND (i = 1 OR i = len(cl) OR {O.blank("coalesce(cl[i - 1], '')")} OR {O.blank("coalesce(cl[i + 1], '')")})),
g AS (SELECT doc_id, list(n) AS again FROM (SELECT doc_id, n FROM b GROUP BY doc_id, n HAVING count(*) >= 2) GROUP BY doc_id),
k AS (SELECT d.doc_id, candidate, cl, again, list_filter(cl, lambda x, i: NOT ({_BESIDE} AND list_contains(again, lower({O.strip("x")})))) AS ks FROM d LEFT JOIN g USING (doc_id)),
c AS (SELECT *, list_transform(list_filter(ks, lambda x, i: NOT ({O.blank("x")} AND i > 1 AND {O.blank("ks[i - 1]")})), lambda x: CASE WHEN {O.blank("x")} THEN '' ELSE x END) AS cs FROM k)
SELECT doc_id, CASE WHEN len(cl) < 3 OR again IS NULL THEN candidate ELSE regexp_replace(array_to_string(cs, chr(10)), '^\\n+|\\n+$', '', 'g') || CASE WHEN ends_with(candidate, chr(10)) AND regexp_replace(array_to_string(cs, chr(10)), '^\\n+|\\n+$', '', 'g') <> '' THEN chr(10) ELSE '' END END AS repaired FROM c""")
def remove_boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(spark, sf_dir).select("doc_id", R.remove_boundary_lines(F.col("candidate")).alias("repaired"))


_LABEL = "'표 ' || (user_id % 9)::VARCHAR || '-' || (event_id % 3)::VARCHAR"


@query(f"""SELECT event_id, user_id % 9 || '-' || event_id % 3 AS number, {_LABEL} AS canonical, ['alpha', 'beta' || (event_id % 2)::VARCHAR] AS tokens,
[(event_id % 5)::VARCHAR || '.5'] AS numbers, event_id % 4 BETWEEN 1 AND 2 AS valid_page, [3, (event_id % 5 + 4)::INT] AS pages FROM events""")
def label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a label, tokens and numbers of a table, pages named in a text."""
    e, u = F.col("event_id"), F.col("user_id")
    label = F.concat(F.lit("Table <"), (u % 9).cast("string"), F.lit("-"), (e % 3).cast("string"), F.lit(">"))
    text = F.concat(F.lit("구분 alpha 12 beta"), (e % 2).cast("string"), F.lit(" alpha 비고"))
    numbers = F.concat((e % 5).cast("string"), F.lit(".5 and "), (e % 5).cast("string"), F.lit(".5"))
    pages = F.concat(F.lit("see p. 3, p."), (e % 5 + 4).cast("string"), F.lit(" and p 3"))
    return table(spark, sf_dir, "events").select(
        "event_id", L.label_number(label).alias("number"), L.canonical_label(label).alias("canonical"), L.table_tokens(text).alias("tokens"), L.table_numbers(numbers).alias("numbers"),
        L.valid_page((e % 4).cast("int"), F.lit(2)).alias("valid_page"), L.page_references(pages).alias("pages"))
