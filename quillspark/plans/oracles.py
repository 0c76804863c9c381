"""DuckDB fragments for the reference answers: the same rules, written again in SQL."""

from __future__ import annotations

from quillspark.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lines(e: str) -> str:
    return f"(CASE WHEN string_split({e}, chr(10))[-1] = '' THEN string_split({e}, chr(10))[:-2] ELSE string_split({e}, chr(10)) END)"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def collapse(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def norm(e: str) -> str:
    return f"lower({collapse(e)})"


def words(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {lit(T.WORD)})"


def blank(e: str) -> str:
    return f"({strip(e)} = '')"


def count(e: str, what: str) -> str:
    return f"(length({e}) - length(replace({e}, {lit(what)}, '')))"


def matches(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {lit(pattern)})"


def table_line(e: str) -> str:
    s = strip(e)
    return f"(({count(s, '|')} >= 2 AND (starts_with({s}, '|') OR ends_with({s}, '|'))) OR starts_with(lower({s}), '<table'))"


def kind(e: str) -> str:
    s = strip(e)
    return f"(CASE WHEN {s} = '' THEN NULL WHEN starts_with({s}, '#') THEN 'heading' WHEN {matches(s, T.LIST_ITEM)} THEN 'list' WHEN {table_line(e)} THEN 'table' END)"


def structural(e: str) -> str:
    s = strip(e)
    tests = " OR ".join(matches(s, p) for p in (T.LIST_ITEM, T.PAREN_ITEM, T.SECTION, T.CAPTION, T.PAGE_MARKER, T.PAGE_FOOTER))
    return f"({s} <> '' AND (starts_with({s}, '#') OR {tests} OR ({count(s, '|')} >= 2 AND (starts_with({s}, '|') OR ends_with({s}, '|')))))"


def structured_source(e: str) -> str:
    s = strip(e)
    return f"({s} <> '' AND ({matches(s, T.HEADING)} OR {matches(s, T.LIST_ITEM)} OR {matches(s, T.SECTION)} OR {matches(s, T.CAPTION)} OR (ends_with({s}, ':') AND length({s}) <= 80)))"


def n_fields(e: str) -> str:
    return rf"len(regexp_extract_all({e}, '\S+'))"


def boundary(e: str) -> str:
    s = strip(e)
    return f"({s} <> '' AND NOT {structural(e)} AND length({s}) <= 80 AND {n_fields(s)} <= 8)"


def merges(a: str, b: str) -> str:
    left, right = rf"regexp_replace({a}, '\s+$', '')", rf"regexp_replace({b}, '^\s+', '')"
    korean = f"(length({left}) >= 25 AND {matches(left, '[가-힣]$')} AND NOT {matches(left, T.KOREAN_TERMINAL)} AND {matches(right, '^[가-힣]')})"
    hyphen = f"(ends_with({left}, '-') AND NOT {matches(strip(a), T.PAGE_FOOTER)})"
    starts = matches(right, r"""^[\p{Ll}\p{Nd}"'(\[]""")
    return f"(NOT {blank(a)} AND NOT {blank(b)} AND NOT {structural(a)} AND NOT {structural(b)} AND NOT {matches(left, '[.!?:;]$')} AND ({hyphen} OR {korean} OR {starts}))"


def clamp(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


def count_similarity(e: str, a: str) -> str:
    return f"(CASE WHEN {e} = 0 THEN (CASE WHEN {a} = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE ELSE {clamp(f'1.0 - abs({e}::DOUBLE - {a}::DOUBLE) / {e}::DOUBLE')} END)"


def count_if(xs: str, test: str) -> str:
    """Elements x of a list that pass a test."""
    return f"len(list_filter({xs}, lambda x: coalesce({test}, false)))"


#: documents with a damaged candidate: every fifth line lost, some twice, blank runs put in.
DAMAGED = f"""
d0 AS (SELECT doc_id, text AS source, {lines("text")} AS sl FROM documents),
d1 AS (
  SELECT doc_id, source, array_to_string(flatten(list_transform(sl, lambda x, i: CASE WHEN (i - 1) % 5 = 3 THEN []::VARCHAR[]
    ELSE list_concat([x], list_concat(CASE WHEN (i - 1) % 7 = 0 THEN [x] ELSE []::VARCHAR[] END, CASE WHEN (i - 1) % 4 = 0 THEN ['', ''] ELSE []::VARCHAR[] END)) END)), chr(10)) AS candidate FROM d0),
d AS (SELECT doc_id, source, candidate, {lines("source")} AS sl, {lines("candidate")} AS cl FROM d1)"""

#: conversations as documents with a heading and a list item per turn.
TALKS = f"""
t0 AS (SELECT conv_id, string_agg('## ' || role || chr(10) || '- turn ' || turn::VARCHAR || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, text, {lines("text")} AS ls FROM t0)"""

#: orders as grids, and damaged ones: third lines lost, even lines' quantities changed.
GRIDS = """
g AS (
  SELECT l_orderkey AS order_id,
    list([l_linenumber::VARCHAR, l_partkey::VARCHAR, l_quantity::BIGINT::VARCHAR, lower(l_returnflag)] ORDER BY l_linenumber, l_partkey, l_quantity) AS a,
    coalesce(list([l_linenumber::VARCHAR, l_partkey::VARCHAR, (l_quantity::BIGINT + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END)::VARCHAR, lower(l_returnflag)] ORDER BY l_linenumber, l_partkey, l_quantity) FILTER (WHERE l_linenumber <> 3), []) AS b
  FROM lineitem GROUP BY l_orderkey)"""

TOKENS = f"""
tk AS (
  SELECT doc_id, token, sum(s)::BIGINT AS s, sum(c)::BIGINT AS c FROM (
    SELECT doc_id, unnest({words("source")}) AS token, 1 AS s, 0 AS c FROM d
    UNION ALL SELECT doc_id, unnest({words("candidate")}), 0, 1 FROM d) GROUP BY ALL)"""
