"""Exact passage deduplication by sparse suffix arrays.

A suffix is kept where a minimiser starts: the smallest hash of ``CORE`` words among
``STRIDE`` neighbouring positions.  With CORE + STRIDE - 1 = 50 words, any two equal
passages of 50 words keep the same suffix inside the passage, whatever surrounds it.

1. Suffix positions of all texts with their core's hash (one scan).
2. Cores that start two different suffixes (partial aggregation by core).
3. Those suffixes meet their texts, which give each the 19 words to its left
   and right beyond the core: all that a window of 50 words around the core can touch.
4. A suffix has up to 20 windows of 50 words around its core, one for each split of the other 19
   words before and after it.  Of the suffixes with an equal window the one with the
   smallest (text fingerprint, place) keeps it; the window marks a span in every text and is
   removable in all others.  The suffixes are sorted by core and right context over range
   partitions (so a passage that a third of all documents share is split over tasks),
   which decide the windows that lie in one partition.  Of windows that may go on in another, a row
   each with the partition's smallest place meets those of the others; the rest of them go.
5. What goes is always still held by a smaller text; spans are united by text.

Whole copies are one text: only the copy with the smallest row fingerprint takes
part, the others are removable whole if they have 50 words.

Words are ``[^\\x20\\x09-\\x0D]+``, compared exactly (64-bit hashes of cores, 32-bit of
context words).

Defined cases: null or short texts have no passage; repeated rows are
copies of one text, one stays; a passage repeated inside one text counts, its first
place stays; an empty table gives no rows; extra columns pass through ``remove``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._arrays import NOT_SPACE, column_words, mix, string_parts, trimmed, window_hashes
from quillspark.llm._store import discard, shared_folder, written

LENGTH, CORE = 50, 31
STRIDE = LENGTH - CORE + 1
REACH = LENGTH - CORE


def minimisers(values: np.ndarray, first: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Sorted indices of the leftmost smallest value of every run of ``stride`` values inside a group.

    first: the groups' bounds.  A group shorter than ``stride`` is one run.
    """
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.int64)
    best, span = np.arange(n), 1
    last = np.repeat(first[1:], np.diff(first)) - 1
    while span < stride:  # best[i]: where the smallest of values[i : i + span] stands, cut at the group's end
        step = min(span, stride - span)
        other = best[np.minimum(np.arange(n) + step, last)]
        best = np.where(values[other] < values[best], other, best)
        span += step
    whole = np.arange(n) + stride - 1 <= last
    start = first[:-1][np.diff(first) > 0]
    whole[start] = True
    chosen = np.zeros(n, dtype=bool)
    chosen[best[whole]] = True
    return np.flatnonzero(chosen)


@trimmed
def _anchors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(both halves of the text key, text) to (key, key2, at, core)."""
    for batch in rows:
        keys, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, _, words in column_words(batch.column(2), NOT_SPACE):
            cores, at = window_hashes(words.hashes(), words.first, CORE)
            pick = minimisers(cores, np.searchsorted(at, words.first))
            doc = np.searchsorted(words.first, at[pick], side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[a + doc]), pa.array(more[a + doc]), pa.array((at[pick] - words.first[doc]).astype(np.int32)), pa.array(cores[pick].view(np.int64))], [*KEY, "at", "core"])


#: A text's fingerprint of 128 bits.
KEY = ["text_key", "text_key2"]
SUFFIX = "core long, right binary, left binary, text_key long, text_key2 long, at int"


@trimmed
def _contexts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(both halves of the text key, text, positions) to suffixes with their context."""
    for batch in rows:
        places = batch.column(3).to_pylist()
        keys, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[list] = [[] for _ in range(6)]
        for a, b, words in column_words(batch.column(2), NOT_SPACE):
            hashes = words.hashes()
            cores, starts = window_hashes(hashes, words.first, CORE)
            short = (hashes >> np.uint64(32)).astype("<u4")
            for d in range(b - a):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                for p in sorted(set(places[a + d])):
                    i = lo + p
                    core = int(cores[np.searchsorted(starts, i)])
                    out[0].append(core - (1 << 64) if core >> 63 else core)
                    out[1].append(short[i + CORE : min(hi, i + CORE + REACH)].tobytes())
                    out[2].append(short[max(lo, i - REACH) : i][::-1].tobytes())
                    out[3].append(keys[a + d])
                    out[4].append(more[a + d])
                    out[5].append(p)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["core", "right", "left", *KEY, "at"])


#: A row is a repeated span, or (core and window are set, goes is null) the smallest place of a window that may go on in another partition.
FOUND = "text_key long, text_key2 long, start int, end int, goes boolean, core long, window long"
_FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]


def _found(n: int, **columns) -> pa.RecordBatch:  # type: ignore[no-untyped-def]
    """A batch of n rows; columns not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_FOUND_NAMES, _FOUND_TYPES, strict=True)], _FOUND_NAMES)


def _prefixes(context: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each context, fingerprints [suffix, k] of its first k words)."""
    data, offsets = string_parts(context)
    sizes = np.diff(offsets) // 4
    values = np.zeros((len(sizes), REACH), dtype=np.uint64)
    values[np.arange(REACH) < sizes[:, None]] = np.frombuffer(data.tobytes(), dtype="<u4")
    out = np.zeros((len(sizes), REACH + 1), dtype=np.uint64)
    for k in range(REACH):
        out[:, k + 1] = mix(out[:, k] + (values[:, k] << np.uint64(8)) + np.uint64(k + 1))
    return sizes, out


class _Windows:
    """Suffixes (core, right, left, text_key, text_key2, at) and the windows of 50 words around their cores.

    Window b of a suffix starts b words before its core.
    """

    def __init__(self, rows: pa.RecordBatch | pa.Table) -> None:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        self.core, self.keys, self.more, self.at = (columns[k].to_numpy() for k in (0, 3, 4, 5))
        (self.n_right, self.right), (self.n_left, self.left) = _prefixes(columns[1]), _prefixes(columns[2])
        self.order = np.lexsort((self.at, self.more, self.keys))
        k, m, a = self.keys[self.order], self.more[self.order], self.at[self.order]
        self.place = np.zeros(len(k), dtype=np.int64)  # equal for equal (text key, at), in their order
        self.place[self.order] = np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (a[1:] != a[:-1])])[: len(k)])

    def whole(self, b: int) -> np.ndarray:
        """Which suffixes have window b inside their text."""
        return (self.n_left >= b) & (self.n_right >= REACH - b)

    def hashes(self, b: int) -> np.ndarray:
        return mix(self.core.view(np.uint64) ^ mix(self.right[:, REACH - b] + mix(self.left[:, b] + np.uint64(b + 1))))

    def same_right(self, b: int, i: int) -> np.ndarray:
        """Which suffixes have suffix i's core and, in window b, its words after the core."""
        return (self.core == self.core[i]) & (self.n_right[i] >= REACH - b) & (self.right[:, REACH - b] == self.right[i, REACH - b])

    def groups(self, b: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(suffixes of ``among`` by window b, group of each, smallest suffix and number of places > 1 of each group)."""
        rows = self.order[among[self.order]]
        hashes = self.hashes(b)[rows]
        by = np.lexsort((hashes, self.core[rows]))  # stable: places stay in order
        rows, hashes = rows[by], hashes[by]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (self.core[rows[1:]] != self.core[rows[:-1]])])[: len(rows)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows))[: len(first)] - 1
        return rows, np.cumsum(new) - 1, rows[first], self.place[rows[last]] > self.place[rows[first]]


class _Spans:
    """What the repeated windows of suffixes cover, and those that go; all of a suffix's windows hold its core."""

    def __init__(self, w: _Windows) -> None:
        self.w, n = w, len(w.at)
        self.least, self.most = np.full((2, n), REACH + 1), np.full((2, n), -1)

    def add(self, b: int, rows: np.ndarray, goes: np.ndarray) -> None:
        for k, r in enumerate((rows, rows[goes])):
            self.least[k, r], self.most[k, r] = np.minimum(self.least[k, r], b), np.maximum(self.most[k, r], b)

    def batch(self) -> pa.RecordBatch:
        out = []
        same = (self.least[0] == self.least[1]) & (self.most[0] == self.most[1])
        for k, some in enumerate(((self.most[0] >= 0) & ~same, self.most[1] >= 0)):
            at = self.w.at[some]
            out.append((self.w.keys[some], self.w.more[some], at - self.most[k, some], at - self.least[k, some] + LENGTH, np.full(len(at), bool(k))))
        keys, more, start, end, goes = (np.concatenate(c) for c in zip(*out, strict=True))
        return _found(len(keys), text_key=keys, text_key2=more, start=start, end=end, goes=goes)


def _decided(w: _Windows, ends: tuple[int, ...]) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
    """(spans, smallest places of open windows) of all suffixes of some cores.

    ends: the suffixes that bound the partition on a side where their core may go on.  In the order
    of core and right context, only windows with the same words after the core as such a
    suffix can have suffixes beyond it: they are open.  Of an open window all but its smallest
    place here are decided as well: they go.
    """
    spans, windows = _Spans(w), []
    for b in range(REACH + 1):
        beyond = np.zeros(len(w.at), dtype=bool)
        for i in ends:
            beyond |= w.same_right(b, i)
        rows, group, least, several = w.groups(b, w.whole(b))
        spans.add(b, rows[several[group]], (w.place[rows] > w.place[least[group]])[several[group]])
        if (least := least[beyond[least]]).size:
            start = w.at[least] - b
            windows.append(_found(len(least), text_key=w.keys[least], text_key2=w.more[least], start=start, end=start + LENGTH, core=w.core[least], window=w.hashes(b)[least].view(np.int64)))
    return spans.batch(), windows


@trimmed
def _repeats(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in the order of core and right context to spans and open windows."""
    held, first = [], True

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        core = table.column(0).to_numpy()
        # The first core may go on before the partition, the last one after it.
        cuts = sorted({0, int(np.searchsorted(core, core[0], side="right")) if first else 0, int(np.searchsorted(core, core[-1])) if last else len(core), len(core)})
        for a, z in itertools.pairwise(cuts):
            ends = (0,) * (first and a == 0) + (z - a - 1,) * (last and z == len(core))
            spans, windows = _decided(_Windows(table.slice(a, z - a)), ends)
            yield spans
            yield from windows

    for batch in rows:
        core = batch.column(0).to_numpy()
        if not len(core):
            continue
        z = int(np.searchsorted(core, core[-1]))
        if held and (z or core[0] != held[-1].column(0)[-1].as_py()):
            held.append(batch.slice(0, z))
            yield from settle(False)
            held, first, batch = [], False, batch.slice(z)
        held.append(batch)
    if held:
        yield from settle(True)


def _matched(suffixes: DataFrame, folder: str) -> DataFrame:
    """Spans of repeated windows: text_key, text_key2, start, end, goes (a smaller place holds them)."""
    columns = ["core", "right", "left", *KEY, "at"]
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(suffixes.repartitionByRange(n, *columns).sortWithinPartitions(*columns).select(*columns).mapInArrow(_repeats, FOUND), f"{folder}/repeats")
    # An open window has a row for each partition that its suffixes are in.
    same, place = Window.partitionBy("core", "window"), F.struct(*KEY, "start")
    met = found.filter("window IS NOT NULL").withColumn("least", F.min(place).over(same)).withColumn("parts", F.count("*").over(same)).filter("parts > 1")
    return found.filter("window IS NULL").select(*KEY, "start", "end", "goes").unionByName(met.select(*KEY, "start", "end", (place != F.col("least")).alias("goes")))


SPANS = "spans array<struct<start:int,end:int>>"


def _united(spans) -> F.Column:  # type: ignore[name-defined]
    """Sorted spans with overlapping ones joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda a: F.element_at(a, -1)

    def add(acc, s):
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last(acc)["end"], joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), empty, add)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *_keys(text, id_col))


def _keys(text, id_col: str) -> list:  # type: ignore[no-untyped-def,type-arg]
    """Both halves of the text's key and the row's key."""
    return [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(2), text).alias("text_key2"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("row_key")]


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with repeated passages: text_key, text_key2, keeper (row key that stays), copies, spans, removable (word spans).

    A row with another row key than ``keeper`` is a whole copy.  A text without a repeated
    passage but with copies has null spans.
    """
    spark = docs.sparkSession
    folder, rows = shared_folder(spark, "suffixes"), _rows(docs, id_col, text_col)
    anchors = written(rows.select(*KEY, "text").mapInArrow(_anchors, "text_key long, text_key2 long, at int, core long"), f"{folder}/anchors")
    place = F.xxhash64(*KEY, "at")
    # Written, so that the join below deals both sides anew and a core that a third of all texts hold is split over tasks.
    shared = written(anchors.groupBy("core").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("core"), f"{folder}/shared")
    texts = rows.groupBy(*KEY).agg(F.min("row_key").alias("keeper"), F.count("*").alias("copies"))
    wanted = anchors.join(shared, "core").groupBy(*KEY).agg(F.collect_set("at").alias("places"))
    wanted = wanted.join(texts, KEY).select(F.col("keeper").alias("row_key"), *KEY, "places")
    suffixes = written(rows.select("row_key", *KEY, "text").join(wanted, ["row_key", *KEY]).select(*KEY, "text", "places").mapInArrow(_contexts, SUFFIX), f"{folder}/suffixes")
    discard(spark, f"{folder}/anchors", f"{folder}/shared")
    found = _matched(suffixes, folder)
    span = F.struct("start", "end")
    spans = found.groupBy(*KEY).agg(F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("goes"), span)).alias("removable"))
    spans = spans.select(*KEY, _united("spans").alias("spans"), _united("removable").alias("removable"))
    result = written(texts.join(spans, KEY, "left").filter("copies > 1 OR spans IS NOT NULL"), f"{folder}/found")
    discard(spark, f"{folder}/suffixes", f"{folder}/repeats")
    return result


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document that holds a repeated passage of 50 words or more; clean documents give none.

    doc_id, n_words, n_repeated and n_removable (words), spans and removable (word
    spans, end exclusive), whole_copy (another row with this text stays).
    """
    found = find_passages(docs, id_col, text_col)
    rows = _rows(docs, id_col, text_col)
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    joined = rows.select("doc_id", *KEY, "row_key", n_words.alias("n_words")).join(found, KEY).filter(f"spans IS NOT NULL OR n_words >= {LENGTH}")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    copied = (F.col("copies") > 1) & (F.col("n_words") >= LENGTH)
    gone = copied & (F.col("row_key") != F.col("keeper"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long")
    out = joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.when(copied, whole).otherwise(F.col("spans")).alias("spans"), F.when(gone, whole).otherwise(F.coalesce("removable", empty)).alias("removable"), gone.alias("whole_copy"))
    return out.select("doc_id", "n_words", total("spans").alias("n_repeated"), total("removable").alias("n_removable"), "spans", "removable", "whole_copy")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows without removable passages; whole copies and texts that lose every word go.

    Same columns; ``chars_col`` (code points of the text) is set anew where text went.
    """
    found, names = find_passages(docs, id_col, text_col), docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("r"), *_keys(text, id_col))
    joined = packed.join(found.select(*KEY, "keeper", "removable", "copies"), KEY, "left")
    n_words = F.regexp_count(F.coalesce(F.col("r")[text_col], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    stays = F.col("keeper").isNull() | (F.col("row_key") == F.col("keeper")) | (n_words < LENGTH)
    kept = joined.filter(stays).select("r", "removable", "row_key", *KEY, F.coalesce("copies", F.lit(1)).alias("copies"), (n_words >= LENGTH).alias("long"))
    # Rows that repeat whole have one row key: one of them stays.
    twice = F.col("copies").__gt__(1) & F.col("long")
    one = kept.filter(twice).groupBy("row_key", *KEY).agg(F.first("r").alias("r"), F.first("removable").alias("removable")).select("r", "removable")
    kept = kept.filter(~twice).select("r", "removable").unionByName(one)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = batch.column(0).flatten(), batch.column(1).to_pylist()
            k, texts, keep, changed = names.index(text_col), {}, np.ones(batch.num_rows, dtype=bool), False
            for a, _, words in column_words(columns[k], NOT_SPACE):
                for d in range(words.n_docs):
                    if s := spans[a + d]:
                        texts[a + d] = _without(words, d, s)
                        changed, keep[a + d] = True, bool(texts[a + d].strip())
            if changed:
                for c, of in ((k, str), (names.index(chars_col) if chars_col else None, len)):
                    if c is not None:
                        values = columns[c].to_pylist()
                        for i, t in texts.items():
                            values[i] = of(t)
                        columns[c] = pa.array(values, columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return kept.mapInArrow(cut, schema)


def _without(words, d: int, spans: list[dict]) -> str:
    base, first, n = int(words.doc_start[d]), int(words.first[d]), int(words.per_doc[d])
    text = words.data[words.doc_start[d] : words.doc_start[d + 1]].tobytes()
    out, at = [], 0
    for s in spans:
        out.append(text[at : int(words.start[first + s["start"]]) - base])
        at = int(words.start[first + s["end"]]) - base if s["end"] < n else len(text)
    out.append(text[at:])
    return b"".join(out).decode()
