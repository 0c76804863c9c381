"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The
windows of the benchmark (13 words; a shorter item is one window) are hashed
into a sorted set that is broadcast; every document's token windows are
scanned against it in one pass without a shuffle, hits are verified word by
word, and documents or word spans are removed.

Bounds: the set is broadcast only up to ``max_chars`` of benchmark text,
measured first.  A larger benchmark is dealt into blocks by a hash of its items;
each block is one bounded broadcast and one scan, whose hits are written by text before the
driver reads the next block.  The blocks' hits are united by text before anything is decided,
so results are the same for any number of blocks.

Defined cases: a null or empty text has no words (0 hits, not contaminated);
an item with null or wordless text has no windows; an item whose id is null
marks words but is not listed; repeated items count once by id; repeated
documents give one row each; an empty table gives no rows, an empty benchmark no
hits.  Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrays import ALNUM, Words, column_words, split_words, string_parts, window_hashes
from quillspark.llm._store import shared_folder, written

WINDOW = 13
#: A document is contaminated if 1/20 of its words or more are hit.
SHARE = 20
#: Characters of benchmark text that one broadcast may hold (about 16 bytes of set for each word).
MAX_CHARS = 1 << 24
_BITS = 20
#: The words of :data:`ALNUM` as a pattern.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


class WindowSet:
    """Sorted window hashes of a bounded set of items, by window length."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW) -> None:
        data, offsets = string_parts(pa.array(texts, pa.string()))
        self.ids, self.words = ids, split_words(data, offsets, ALNUM)
        hashes, counts = self.words.hashes(lower=True), self.words.per_doc
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({*np.minimum(counts[counts > 0], window).tolist()}):
            wh, at = window_hashes(hashes, self.words.first, size)
            item = np.searchsorted(self.words.first, at, side="right") - 1
            if size < window:  # windows of shorter items only
                own = counts[item] == size
                wh, at = wh[own], at[own]
            order = np.argsort(wh, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[wh & np.uint64((1 << _BITS) - 1)] = True
            self.by_size[size] = wh[order], at[order], bits

    def _same(self, i: int, words: Words, j: int, size: int) -> bool:
        return all(self.words.word(i + k, True) == words.word(j + k, True) for k in range(size))

    def scan(self, words: Words) -> dict[int, tuple[np.ndarray, set[str]]]:
        """For each document with a verified hit: positions of hit words, and ids."""
        hashes, out = words.hashes(lower=True), {}
        for size, (known, where, bits) in self.by_size.items():
            wh, at = window_hashes(hashes, words.first, size)
            maybe = np.flatnonzero(bits[wh & np.uint64((1 << _BITS) - 1)])
            lo, hi = (np.searchsorted(known, wh[maybe], side=s) for s in ("left", "right"))
            for k in np.flatnonzero(hi > lo):
                j = int(at[maybe[k]])
                items = {int(np.searchsorted(self.words.first, i, side="right")) - 1 for i in where[lo[k] : hi[k]] if self._same(int(i), words, j, size)}
                if items:
                    d = int(np.searchsorted(words.first, j, side="right")) - 1
                    starts, ids = out.setdefault(d, ([], set()))
                    starts.append((j - int(words.first[d]), size))
                    ids.update(self.ids[i] for i in items if self.ids[i] is not None)
        return {d: (np.unique(np.concatenate([np.arange(s, s + n) for s, n in starts])), ids) for d, (starts, ids) in out.items()}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, max_chars: int) -> tuple[int, Iterator[WindowSet]]:
    """(number of blocks, the blocks, each read when it is asked for)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // max_chars) or 1

    def read() -> Iterator[WindowSet]:
        for k in range(n):
            rows = (items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()
            yield WindowSet([r.i for r in rows], [r.t for r in rows])

    return n, read()


def _scan_with(sets, all_rows: bool):
    """Function for mapInArrow on (key, text): rows with hits' positions and items, all or those with hits."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.num_rows
            n_words, hits, items = np.zeros(n, dtype=np.int64), [None] * n, [None] * n
            for a, b, words in column_words(batch.column(1), ALNUM):
                n_words[a:b] = words.per_doc
                for d, (at, ids) in sets.value.scan(words).items():
                    hits[a + d], items[a + d] = at.astype(np.int32), sorted(ids)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["key", "n_words", "hits", "items"])
            yield out if all_rows else out.filter(out.column(2).is_valid())

    return run


FOUND = "key {key}, n_words long, hits array<int>, items array<string>"


def _text_key(text) -> F.Column:  # type: ignore[name-defined,no-untyped-def]
    return F.unhex(F.md5(text.cast("binary")))


def _hits_by_text(docs: DataFrame, text_col: str, blocks: Iterator[WindowSet]) -> DataFrame:
    """(key, hits, items) of the texts with hits in any block; the driver holds one block at a time."""
    spark = docs.sparkSession
    folder, texts, parts = shared_folder(spark, "decontamination"), docs.select(_text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")), []
    for k, sets in enumerate(blocks):
        shared = spark.sparkContext.broadcast(sets)
        found = texts.mapInArrow(_scan_with(shared, False), FOUND.format(key="binary"))
        parts.append(written(found.groupBy("key").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), f"{folder}/{k}"))
        shared.destroy()
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return written(both.groupBy("key").agg(united("hits"), united("items")), f"{folder}/all")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, hits (positions of hit words, null if none), items (ids, null if none)."""
    n, blocks = _blocks(benchmark, item_col, item_text_col, max_chars)
    if n == 1:
        rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
        shared = docs.sparkSession.sparkContext.broadcast(next(blocks))
        return rows.mapInArrow(_scan_with(shared, True), FOUND.format(key=rows.schema["key"].dataType.simpleString())).withColumnRenamed("key", "doc_id")
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words.alias("n_words"), _text_key(F.col(text_col)).alias("key"))
    return rows.join(_hits_by_text(docs, text_col, blocks), "key", "left").select("doc_id", "n_words", "hits", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """Digest of :func:`find_contamination`: counts, the items' SHA-256 and the verdict."""
    n_hit, ids = F.coalesce(F.size("hits"), F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.when(F.col("hits").isNull(), 0).otherwise(n_hit).cast("long")
    return find_contamination(docs, benchmark, **columns).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def without_spans(text: bytes, words: Words, d: int, hits: np.ndarray) -> str:
    """The text of document d without the bytes from the first to the last word of each hit run."""
    base, first = int(words.doc_start[d]), int(words.first[d])
    cut = np.flatnonzero(np.diff(hits) > 1)
    out, at = [], 0
    for s, e in zip(hits[np.r_[0, cut + 1]], hits[np.r_[cut, len(hits) - 1]], strict=True):
        out.append(text[at : int(words.start[first + s]) - base])
        at = int(words.end[first + e]) - base
    out.append(text[at:])
    return b"".join(out).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars_col: str | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """The same columns without contaminated documents; from the others hit spans are cut out.

    ``chars_col``: a column that holds the text's code points, set anew where a
    span went.  Clean rows pass unchanged.  A document is judged once, by its hits in all blocks.
    """
    n, blocks = _blocks(benchmark, item_col, item_text_col, max_chars)
    names, schema = docs.columns, docs.schema
    k, k_chars = names.index(text_col), names.index(chars_col) if chars_col else None
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(blocks))

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _cut(batch, k, k_chars, lambda words, a: ((d, at) for d, (at, _) in shared.value.scan(words).items()))

        return docs.mapInArrow(scanned, schema)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("r"), _text_key(F.col(text_col)).alias("key"))
    joined = rows.join(_hits_by_text(docs, text_col, blocks).select("key", "hits"), "key", "left").select("r", "hits")

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(1).to_pylist()
            own = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=names)
            yield _cut(own, k, k_chars, lambda words, a, hits=hits: ((d, np.array(hits[a + d])) for d in range(words.n_docs) if hits[a + d]))

    return joined.mapInArrow(given, schema)


def _cut(batch: pa.RecordBatch, k: int, k_chars: int | None, hits_of: Callable) -> pa.RecordBatch:  # type: ignore[type-arg]
    """The batch without contaminated rows and hit spans; hits_of: (words of a slice, its first row) to (row, positions)."""
    keep, changed = np.ones(batch.num_rows, dtype=bool), {}
    for a, _, words in column_words(batch.column(k), ALNUM):
        for d, hits in hits_of(words, a):
            if SHARE * len(hits) >= words.per_doc[d]:
                keep[a + d] = False
            else:
                changed[a + d] = without_spans(words.data[words.doc_start[d] : words.doc_start[d + 1]].tobytes(), words, d, hits)
    if changed:
        columns = list(batch.columns)
        for c, of in ((k, str), (k_chars, len)):
            if c is not None:
                values = columns[c].to_pylist()
                for i, t in changed.items():
                    values[i] = of(t)
                columns[c] = pa.array(values, columns[c].type)
        batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return batch if keep.all() else batch.filter(pa.array(keep))


def sha_of_items(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: :func:`contamination_report` for DuckDB.
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS size, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT rid, i, size, item FROM dw JOIN bw USING (size, g)),
n AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, size)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
