"""Packing tokenised documents into windows by non-negative least squares.

A document's ids (byte-level BPE, then one end id) are cut at multiples of the
window, so each full cut is a sequence of its own; only the remainders, shorter
than the window, need packing.  Their length histogram (one number per length
below the window) decides the plan: shallow combinations of lengths that fill
the window are enumerated, NNLS solves how often to repeat each, the
repeats are rounded down to what the histogram holds, and the residual pieces
are packed greedily (best fit decreasing) together with what the plan could
not place.  The residual is bounded by the number of combinations, not
by the corpus, and so is the plan that reaches every row: rank ranges for
each length.  Ranks within a length come from per-task counters and prefix
sums over tasks, so no task ever holds one length's pieces.

Ids are those of the ``tokenizers`` library for the given file.  Texts of
characters below U+0250 go through the same vocabulary as ranks, which gives the
same ids faster; every other text, and all texts if no rank file is given,
goes through ``tokenizers`` itself.

Defined cases: null text is empty and packs as its end id alone; repeated rows
are packed as separate documents; a very long text is many full cuts; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrays import batches, texts_of, trimmed
from quillspark.llm._store import shared_folder, written

WINDOW = 1024
END = 0
#: Lengths in a combination, at most.
DEPTH = 4
SPECIAL = "<|endoftext|>"
_BEYOND = re.compile("[^\x00-ɏ]")


class BpeEncoder:
    """Ids of texts by a ``tokenizers`` file; ``ranks`` is the same vocabulary for tiktoken."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or SPECIAL in text or _BEYOND.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


@lru_cache(maxsize=1)
def _encoder(path: str, ranks: str | None, pattern: str | None) -> BpeEncoder:
    """One for each worker, not for each task."""
    return BpeEncoder(path, ranks, pattern)


PIECES = "task int, rank long, doc_id {id}, start long, length int, ids_crc32 long, doc_tokens long"


def _pieces_with(path: str, ranks: str | None, pattern: str | None, window: int):
    """Function for mapInArrow on (doc_id, text): a row per piece; rank counts a task's pieces of one length."""

    @trimmed
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, seen = TaskContext.get().partitionId(), _encoder(path, ranks, pattern), np.zeros(window + 1, dtype=np.int64)
        for batch in batches(rows, 512):
            at, starts, lengths, crcs, totals, order = [], [], [], [], [], []
            for d, text in enumerate(texts_of(batch.column(1))):
                ids = np.append(encoder.ids(text), np.array([END], dtype="<u4"))
                n, raw = len(ids), memoryview(ids.tobytes())
                for s in range(0, n, window):
                    k = min(window, n - s)
                    at.append(d)
                    starts.append(s)
                    lengths.append(k)
                    crcs.append(zlib.crc32(raw[4 * s : 4 * (s + k)]))
                    totals.append(n)
                    order.append(seen[k])
                    seen[k] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), task, dtype=np.int32)), pa.array(order, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64())], ["task", "rank", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600, close: float = 1e-7) -> np.ndarray:
    """x >= 0 of least ||a x - b||: accelerated projected gradient with restarts, until steps are as small as ``close``."""
    lip = float(np.abs(a).sum(0).max() * np.abs(a).sum(1).max()) or 1.0
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        step = np.maximum(y - a.T @ (a @ y - b) / lip, 0)
        if (y - step) @ (step - x) > 0:
            y, t = x, 1.0
            continue
        s, moved = (1 + (1 + 4 * t * t) ** 0.5) / 2, float(np.abs(step - x).max(initial=0))
        x, y, t = step, step + (t - 1) / s * (step - x), s
        if moved <= close:
            break
    return x


def combinations(counts: np.ndarray, window: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Shallow multisets of present lengths that fill the window, near-exact if none does.

    Pairs are complete: every length with the largest partner that fits.
    Deeper ones join a length to the fullest combination of the room that is left,
    for a grid of second lengths; the six fullest of each first length stay.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    below = np.zeros(window + 1, dtype=int)  # the largest present length that is at most i
    for i in range(1, window + 1):
        below[i] = i if counts[i] else below[i - 1]
    found: set[tuple[int, ...]] = set()
    grid = present[np.unique(np.linspace(0, len(present) - 1, 12).astype(int))]
    for a in present.tolist():
        heads = [(a,)] + [(a, int(b)) for b in grid if a + b < window] + ([(a, int(b), int(c)) for b in grid[::4] for c in grid[::4] if a + b + c < window] if depth > 3 else [])
        own: set[tuple[int, ...]] = set()
        for head in heads:
            combo, room = list(head), window - sum(head)
            while room > 0 and below[room] and len(combo) < depth:
                combo.append(int(below[room]))
                room -= combo[-1]
            own.add(tuple(sorted(combo)))
        found.update(sorted(own, key=lambda c: (window - sum(c), len(c), c))[:6])
    return sorted(found)


class Slot(NamedTuple):
    """Pieces of a length with rank in [low, high) go to sequence first + (rank - low) // each; offset + length * ((rank - low) % each)."""

    length: int
    low: int
    high: int
    first: int
    each: int
    offset: int


def plan(counts: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> tuple[list[Slot], int]:
    """Slots that place counts[length] pieces of each length below the window; how many sequences they fill."""
    combos = combinations(counts, window, depth)
    left, slots, sequence, taken = counts.astype(np.int64).copy(), [], 0, np.zeros(len(counts), dtype=np.int64)

    def place(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in sorted(set(combo), reverse=True):
            each = combo.count(length)
            slots.append(Slot(length, int(taken[length]), int(taken[length]) + times * each, sequence, each, offset))
            taken[length] += times * each
            left[length] -= times * each
            offset += each * length
        sequence += times

    if combos:
        a = np.zeros((window + 1, len(combos)), dtype=np.float64)
        for j, c in enumerate(combos):
            for length in c:
                a[length, j] += 1
        scale = max(1.0, float(counts.max()))
        x = np.floor(nnls(a, counts / scale) * scale + 1e-6).astype(np.int64)
        for j in np.argsort([window - sum(c) for c in combos], kind="stable"):
            times = min([int(x[j]), *(int(left[n]) // combos[j].count(n) for n in set(combos[j]))])
            if times > 0:
                place(combos[j], times)
    # What rounding left: whole runs of equal best fits at once, so the work follows lengths, not pieces.
    while (present := np.flatnonzero(left)).size:
        combo, room = [int(present[-1])], window - int(present[-1])
        while True:
            fit = [int(n) for n in present[present <= room] if left[n] > combo.count(int(n))]
            if not fit:
                break
            combo.append(fit[-1])
            room -= fit[-1]
        place(tuple(combo), min(int(left[n]) // combo.count(n) for n in set(combo)))
    return slots, sequence


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECES.format(id=rows.schema["doc_id"].dataType.simpleString())
    pieces = written(rows.mapInArrow(_pieces_with(tokenizer, ranks, pattern, window), schema), shared_folder(spark, "packing"))
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # The prefix sums run over (length, task) pairs: at most a window's lengths for each task.
    from pyspark.sql import Window as W

    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length, window at most
        counts[r.length] = r.n
    n_full, counts[window] = int(counts[window]), 0
    slots, n_packed = plan(counts, window)
    slots.append(Slot(window, 0, n_full, n_packed, 1, 0))
    # Slots by length as arrays: a piece looks through the few slots of its length.
    table = spark.createDataFrame([tuple(s) for s in slots], "length int, low long, high long, first long, each long, at long")
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "each", "at"))).alias("slots"))
    placed = pieces.join(bases.select("task", "length", "base"), ["task", "length"])
    placed = placed.join(F.broadcast(by_length), "length").withColumn("r", F.col("rank") + F.col("base"))
    slot = placed.withColumn("slot", F.filter("slots", lambda s: (s["low"] <= F.col("r")) & (F.col("r") < s["high"]))[0]).withColumn("k", F.col("r") - F.col("slot.low"))
    return slot.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("slot.first") + F.floor(F.col("k") / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.at") + F.col("length") * (F.col("k") % F.col("slot.each"))).cast("long").alias("offset"),
    )
