"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: navigation (bars between words), symbols,
shouting, repetition, boilerplate, and long lines without closing punctuation.
Failing lines are removed; then a document is rejected if it fails the base
rules (fewer than 20 words, or 8-word windows that occur again cover over 30 %
of its words) or if removed lines held more than ``MOST_LOST`` of its words.

A document's work stays in its own row: no shuffle, no explode.  Repeated windows are
found by sorting 64-bit window hashes with their positions, and only in documents in which
some window does occur twice.

Defined cases: a null text is empty: no words, ``base_failed``, not kept, and
its cleaned text is empty; an empty table gives no rows; repeated rows are judged each;
other columns pass through ``clean`` untouched, whatever their names; in ``line_first`` its
result columns stand in place of columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Per cent of a document's words that removed lines may hold.
MOST_LOST = 50

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CLOSING = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
# Phrases of licence, consent and account lines.
BOILERPLATE = "all rights reserved|licensed under|general public license|creative commons|copyright|©|cookie|privacy policy|terms of (use|service)|subscribe to|click here|enable javascript|share on"


def _line_fails(line: Column, words: Column) -> Column:
    n, bars = F.size(words), F.regexp_count(line, F.lit(r"\|"))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    navigation = (bars > 0) & (bars * 5 >= n)
    noisy = symbols * 8 > F.length(line)
    shouting = (n >= 3) & (line == F.upper(line)) & (line != F.lower(line))
    repeating = (n >= 10) & (F.size(F.array_distinct(words)) * 10 < n * 3)
    boilerplate = (n <= 30) & F.lower(line).rlike(BOILERPLATE)
    unclosed = (n >= 10) & ~line.rlike(CLOSING)
    return navigation | noisy | shouting | repeating | boilerplate | unclosed


def line_first(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, kept and cleaned_text."""
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = _judged(docs.select(packed, F.coalesce(F.col(text_col), F.lit("")).alias("_q_text")))
    return judged.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in MADE), *MADE)


#: The result columns of :func:`line_first`.
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept", "cleaned_text"]


def _judged(rows: DataFrame) -> DataFrame:
    """(row, _q_text) to row and the result columns."""
    rows = rows.withColumn("_q_lines", F.transform(F.split("_q_text", "\n", -1), lambda s: F.struct(s.alias("line"), F.regexp_extract_all(s, F.lit(WORD), 0).alias("words"))))
    rows = rows.withColumn("_q_words", F.flatten(F.transform("_q_lines", lambda s: s["words"])))
    rows = rows.withColumn("_q_fail", F.transform("_q_lines", lambda s: (F.size(s["words"]) > 0) & _line_fails(s["line"], s["words"])))
    rows = rows.withColumn("n_words", F.size("_q_words").cast("long"))
    hashes = F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice("_q_words", i, WINDOW)))
    rows = rows.withColumn("_q_windows", F.when(F.col("n_words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    ranked = F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_q_ranked", F.when(again, ranked))
    same = lambda i, s: F.get("_q_ranked", i)["h"] == s["h"]
    repeats = F.filter("_q_ranked", lambda s, i: F.coalesce(((i > 0) & same(i - 1, s)) | same(i + 1, s), F.lit(False)))
    rows = rows.withColumn("_q_at", F.sort_array(F.transform(repeats, lambda s: s["i"])))
    covered = F.transform("_q_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_at", i + 1) - p, F.lit(WINDOW))))
    lines = F.transform(F.filter("_q_lines", lambda s: F.size(s["words"]) > 0), lambda s: s["line"])
    rows = rows.withColumn("_q_full", lines)
    flagged = F.arrays_zip(F.col("_q_lines").alias("l"), F.col("_q_fail").alias("f"))
    rows = rows.withColumn("_q_flagged", flagged)
    rows = rows.withColumns({
        "word_chars": F.length(F.regexp_replace("_q_text", r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count("_q_text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_q_full") - F.size(F.array_distinct("_q_full"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        "n_lost_words": F.aggregate("_q_flagged", F.lit(0), lambda a, x: a + F.when(x["f"], F.size(x["l"]["words"])).otherwise(0)).cast("long"),
        "cleaned_text": F.array_join(F.transform(F.filter("_q_flagged", lambda x: ~x["f"]), lambda x: x["l"]["line"]), "\n"),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") * 100 <= F.col("n_words") * MOST_LOST))
    return rows.select("row", *MADE)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Kept documents with their cleaned text in ``text_col``; all other columns as they are, whatever their names."""
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = _judged(docs.select(packed, F.coalesce(F.col(text_col), F.lit("")).alias("_q_text"))).filter("kept")
    return kept.select(*((F.col("cleaned_text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return line_first(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


#: :func:`report` for DuckDB, with window texts in place of hashes.
REPORT_SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
  SELECT rid, line, regexp_extract_all(line, '{WORD}') AS w
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM base)),
judged AS (
  SELECT rid, line, len(w) AS n, len(w) > 0 AND (
    (len(regexp_extract_all(line, '\|')) > 0 AND len(regexp_extract_all(line, '\|')) * 5 >= len(w))
    OR len(regexp_extract_all(line, '{SYMBOLS}')) * 8 > length(line)
    OR (len(w) >= 3 AND line = upper(line) AND line <> lower(line))
    OR (len(w) >= 10 AND len(list_distinct(w)) * 10 < len(w) * 3)
    OR (len(w) <= 30 AND regexp_matches(lower(line), '{BOILERPLATE}'))
    OR (len(w) >= 10 AND NOT regexp_matches(line, '{CLOSING.replace("'", "''")}'))) AS fails
  FROM lines),
by_line AS (
  SELECT rid, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dup
  FROM judged GROUP BY rid),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM base),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, dup AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, lost AS n_lost_words
  FROM words JOIN by_line USING (rid) LEFT JOIN hit USING (rid)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_lost_words * 100 <= n_words * {MOST_LOST} AS kept, n_lost_words::BIGINT AS n_lost_words
FROM f
"""
