"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's elements are its distinct five-word shingles, weighted by how often they stand in it.
Every element sends the arrivals of a Poisson process, whose rate is its weight, to random
registers; a register keeps the earliest arrival's element, and an element stops as soon as its
next arrival is later than every register's.  Two texts agree in a register with the probability
Jaccard similarity of their weighted shingles.  That is the one similarity here: registers are cut
into bands, texts that agree in a band share a bucket, and a pair of one bucket is a link if
its exact probability Jaccard similarity is 0.8 or more.  Without repeated shingles it is the
Jaccard similarity of the shingle sets.

Exact copies are one text.  No pairs within a group are written or shuffled:

1. Every bucket has a centre, its text with most company.  Each text meets the centres of its buckets.
2. What that leaves in several components within a bucket meets in a cell for the bucket: all
   members outside the bucket's largest component (the leaders) against all its members.
   Large cells are dealt over blocks of leaders and parts of members.

A cell first compares sketches (four bits of each register) and passes on the members
that have a partner near the threshold or above (``MOST_DIFFERENT``).  Only these meet again with
their texts: pairs of different components are verified and united at once, and a cell
returns only the links that joined two components, fewer than it has members.  So every link
between two texts of a bucket is returned or implied by returned ones, but for those that the
sketch misses; nothing is capped.  Components come from label propagation with
pointer jumping on tables in the shared folder.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of one to four words is one
shingle.

Defined cases: null text is empty; texts without words are equal only to
the same text; repeated rows are copies; ties go to the smallest id; a very long text is one
text; an empty table gives no rows; extra columns pass through ``keep_one``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrays import NOT_SPACE, Words, column_words, mix, string_parts, trimmed, window_hashes
from quillspark.llm._store import shared_folder, written

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**20 > 0.9996.
BANDS, ROWS = 20, 5
#: Registers of the sketch; the bands use the first of them.
REGISTERS = 128
#: Registers that may differ in a pair that is verified; at similarity 0.8 more do so with probability 0.0003.
MOST_DIFFERENT = 40
#: Members and leaders of a cell that meet in one task, by number and by bytes of text; more are dealt over several.
DEALT, DEALT_BYTES = 1024, 1 << 24


def elements(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted by document and hash."""
    hashes = words.hashes(lower=True)
    shingles, at = window_hashes(hashes, words.first, SHINGLE)
    doc = np.searchsorted(words.first, at, side="right") - 1
    n = words.per_doc
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        one, _ = window_hashes(hashes[words.first[d] : words.first[d + 1]], np.array([0, n[d]]), int(n[d]))
        shingles, doc = np.append(shingles, one), np.append(doc, d)
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[new], shingles[new], np.diff(np.append(new, len(doc)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures [document, register]: the element that arrives first in each register."""
    first = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, dtype=np.uint64)
    latest = np.full(n_docs, np.inf)
    time, rate, k = np.zeros(len(doc)), weight.astype(np.float64), 0
    while len(doc):
        k += 1
        draw = mix(element + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) / 2.0**53) / rate
        active = time < latest[doc]
        doc, element, time, rate, draw = doc[active], element[active], time[active], rate[active], draw[active]
        at = doc * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = element[won]
        latest = first.reshape(n_docs, registers).max(axis=1)
    return winner.reshape(n_docs, registers)


@trimmed
def _signatures(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tk, rk, text) to (doc_id, tk, rk, size, buckets, sketch)."""
    place = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for batch in rows:
        buckets: list[np.ndarray | None] = []
        sketches: list[bytes] = []
        for _, _, words in column_words(batch.column(3), NOT_SPACE):
            doc, element, count = elements(words)
            sig = prob_minhash(doc, element, count, words.n_docs, REGISTERS)
            rows_of = sig[:, : BANDS * ROWS].reshape(words.n_docs, BANDS, ROWS)
            band = np.zeros((words.n_docs, BANDS), dtype=np.uint64) + place
            for r in range(ROWS):
                band = mix(band ^ rows_of[:, :, r])
            buckets += [b if n else None for b, n in zip(band.view(np.int64), words.per_doc, strict=True)]
            whole = np.concatenate([_packed(mix(sig), 4), _packed(band, 32)], axis=1)
            sketches += [w.tobytes() for w in whole]
        size = pc.coalesce(pc.binary_length(batch.column(3)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], size, pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "tk", "rk", "size", "buckets", "sketch"])


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each value, side by side in 64-bit numbers."""
    each = 64 // bits
    n = -(-values.shape[1] // each)
    low = np.zeros((len(values), n * each), dtype=np.uint64)
    low[:, : values.shape[1]] = values & np.uint64((1 << bits) - 1)
    return (low.reshape(len(values), n, each) << (np.arange(each, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64)


_WIDE = REGISTERS // 16
_LOW = np.uint64(0x1111111111111111)


class Weighted:
    """Weighted shingles of some texts: sorted hashes with counts, text after text."""

    def __init__(self, column: pa.Array) -> None:
        parts = [(doc + a, element, count) for a, _, words in column_words(column, NOT_SPACE) for doc, element, count in [elements(words)]]
        doc, self.hashes, self.counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = np.searchsorted(doc, np.arange(len(column) + 1))
        total = np.concatenate([[0], np.cumsum(self.counts)])
        self.weight = total[self.first[1:]] - total[self.first[:-1]]
        self.plain = self.weight == np.diff(self.first)

    def similarities(self, of: Weighted, k: int, among: np.ndarray) -> np.ndarray:
        """Probability Jaccard similarities of text k of ``of`` with these texts of this."""
        own = slice(of.first[k], of.first[k + 1])
        h, n = of.hashes[own], self.first[among + 1] - self.first[among]
        if not len(h):
            return np.zeros(len(among))
        begin = np.cumsum(n) - n
        flat = np.arange(n.sum()) - np.repeat(begin - self.first[among], n)
        values = self.hashes[flat]
        at = np.minimum(np.searchsorted(h, values), len(h) - 1)
        both = h[at] == values
        common = np.diff(np.concatenate([[0], np.cumsum(both)])[np.append(begin, len(flat))])
        out = common / np.maximum(len(h) + n - common, 1)
        for i in np.flatnonzero(~(self.plain[among] & of.plain[k]) & (common > 0)):
            run = slice(begin[i], begin[i] + n[i])
            out[i] = probability_jaccard(of.counts[own][at[run][both[run]]], self.counts[flat[run]][both[run]], int(of.weight[k]), int(self.weight[among[i]]))
        return out


def probability_jaccard(a: np.ndarray, b: np.ndarray, weight_a: int, weight_b: int) -> float:
    """Sum over the common elements i, with weights a and b, of 1 / sum over all j of max(a_j / a_i, b_j / b_i)."""
    order = np.argsort(b / a, kind="stable")
    a, b = a[order].astype(np.float64), b[order].astype(np.float64)
    # j with a ratio up to i's have the larger weight in a, the others in b.
    upper = weight_a - a.sum() + np.cumsum(a)
    above = weight_b - np.cumsum(b)
    return float((1 / (upper / a + above / b)).sum())


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` 64-bit numbers each, as rows."""
    return np.frombuffer(string_parts(column)[0].tobytes(), dtype="<u8").reshape(len(column), width)


#: Columns of a cell's rows; the text is there when pairs are verified.
CELL = "cell long, block int, part int, member boolean, band int, tk binary, root binary, sketch binary"


class _Side:
    """Leaders, or some members, of one cell as arrays."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.rows, self.keys = rows, rows.column(5)
        self.roots = _numbers(rows.column(6), 2)[:, 0].copy()
        whole = _numbers(rows.column(7), _WIDE + BANDS // 2)
        self.registers, self.lanes = whole[:, :_WIDE], np.ascontiguousarray(whole[:, _WIDE:]).view("<u4")
        self.hit = np.zeros(rows.num_rows, dtype=bool)
        self.sets: Weighted | None = None

    def near(self, k: int, others: _Side, band: int) -> np.ndarray:
        """Which others are near enough to k by sketch, in another component, and share no earlier band."""
        x = others.registers ^ self.registers[k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        found = np.flatnonzero((np.bitwise_count(x & _LOW).sum(axis=1) <= MOST_DIFFERENT) & (others.roots != self.roots[k]))
        return found[~(others.lanes[found, :band] == self.lanes[k, :band]).any(axis=1)] if band else found


def _cells(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Side, pa.RecordBatch, bool]]:
    """(leaders, some members, whether they are the cell's first) of rows in the order of cell, block, part and member."""
    at, leaders, party = None, [], None
    for batch in rows:
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0) if batch.num_rows > 1 else np.zeros(0, dtype=bool)
        for i, j in itertools.pairwise([*([0] if batch.num_rows else []), *(np.flatnonzero(new) + 1), batch.num_rows]):
            place = tuple(k[i] for k in keys[:3])
            if place != at:
                at, leaders, party = place, [], None
            if not keys[3][i]:
                leaders.append(batch.slice(i, j - i))
            elif leaders:
                first = party is None
                party = party or _Side(pa.Table.from_batches(leaders).combine_chunks().to_batches()[0])
                yield party, batch.slice(i, j - i), first


@trimmed
def _near_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaders and members that have a near partner in another component."""
    for leaders, batch, _ in _cells(rows):
        members, band = _Side(batch), batch.column(4)[0].as_py()
        told = leaders.hit.copy()
        for k in range(len(leaders.roots)):
            near = leaders.near(k, members, band)
            members.hit[near] = True
            leaders.hit[k] |= len(near) > 0
        for side, hit in ((leaders, leaders.hit & ~told), (members, members.hit)):
            if hit.any():
                yield side.rows.filter(pa.array(hit))


def _linking(similarity: float):  # type: ignore[no-untyped-def]
    @trimmed
    def links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with texts to the verified links that join two components."""
        joined: dict[int, int] = {}  # of one cell: component to the one it is in now
        for leaders, batch, first in _cells(rows):
            joined = {} if first else joined
            if first:
                leaders.sets = Weighted(leaders.rows.column(8))
            members, sets, band = _Side(batch), Weighted(batch.column(8)), batch.column(4)[0].as_py()
            for i, r in enumerate(members.roots.tolist()):
                while r in joined:
                    r = joined[r]
                members.roots[i] = r
            found: list[tuple[int, int]] = []
            for k in range(len(leaders.roots)):
                near = leaders.near(k, members, band)
                if not len(near):
                    continue
                for i in near[sets.similarities(leaders.sets, k, near) >= similarity - 1e-12]:
                    one, other = int(members.roots[i]), int(leaders.roots[k])
                    if one != other:
                        joined[one] = other
                        members.roots[members.roots == one] = other
                        leaders.roots[leaders.roots == one] = other
                        found.append((k, i))
            if found:
                ends = [leaders.keys.take(pa.array([k for k, _ in found])), members.keys.take(pa.array([int(i) for _, i in found]))]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return links


def _met(members: DataFrame, leaders: DataFrame, texts: DataFrame, rows: DataFrame, similarity: float, folder: str) -> DataFrame:
    """Links (a, b) that join components of members (cell, band, tk, root, size) with leaders of the same cell."""
    dealt = lambda name: F.ceil(F.greatest(F.count("*") / DEALT, F.sum("size") / DEALT_BYTES)).cast("int").alias(name)
    dims = written(members.groupBy("cell").agg(dealt("parts")).join(leaders.groupBy("cell").agg(dealt("blocks")), "cell"), f"{folder}/cells")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    drawn = lambda n: F.pmod(F.xxhash64("tk"), F.col(n)).cast("int")
    own = members.join(dims, "cell").select("cell", upto("blocks").alias("block"), drawn("parts").alias("part"), F.lit(True).alias("member"), "band", "tk", "root")
    lead = leaders.join(dims, "cell").select("cell", drawn("blocks").alias("block"), upto("parts").alias("part"), F.lit(False).alias("member"), "band", "tk", "root")
    place = ["cell", "block", "part"]

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(*place).sortWithinPartitions(*place, "member")

    cells = own.unionByName(lead).join(texts.select("tk", "sketch"), "tk").select(*(c.split()[0] for c in CELL.split(", ")))
    near = written(together(cells).mapInArrow(_near_rows, CELL), f"{folder}/near")
    needed = near.select("tk").distinct().join(texts.select("tk", "rk"), "tk").select("rk")
    pool = rows.select("rk", "tk", "text").join(needed, "rk").groupBy("tk").agg(F.first("text").alias("text"))
    return written(together(near.join(pool, "tk").select(*near.columns, "text")).mapInArrow(_linking(similarity), "a binary, b binary"), f"{folder}/links")


def connected(links: DataFrame, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for the nodes of links (a, b) and of ``known`` components; root: the smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks twice, and
    contracts the links to those between different roots, so what is joined shrinks.
    """
    if known is not None:
        links = _moved(links, known)
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{folder}/links-0")
    labels, k = None, 0
    while k == 0 or not links.isEmpty():
        k += 1
        ends = links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")))
        hooks = ends.groupBy("node").agg(F.min("root").alias("root"))
        for _ in range(2):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
            hooks = hooks.join(up, "root").select("node", F.col("far").alias("root"))
        hooks = written(hooks, f"{folder}/hooks-{k}")
        labels = hooks if labels is None else written(_rooted(labels, hooks), f"{folder}/labels-{k}")
        links = written(_moved(links, hooks).filter("a <> b").distinct(), f"{folder}/links-{k}")
    if known is None:
        return labels
    old = _rooted(known, labels)
    return written(old.unionByName(labels.join(known.select("node"), "node", "left_anti")), f"{folder}/all")


def _rooted(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """Labels whose roots have gone to other roots."""
    up = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return labels.join(up, "root", "left").select("node", F.coalesce("far", "root").alias("root"))


def _moved(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between the roots of their ends, the smaller first."""
    first = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    second = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    moved = links.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *_keys(text, id_col), text.alias("text"))


def _keys(text, id_col: str) -> tuple:  # type: ignore[no-untyped-def,type-arg]
    """Keys of a text and of its row."""
    return F.unhex(F.md5(text.cast("binary"))).alias("tk"), F.xxhash64(text, F.col(id_col)).alias("rk")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per distinct text: tk (its MD5), first_id (smallest id of its rows) with that row's key rk, class_id, class_tk (the text that stands for the class)."""
    spark = docs.sparkSession
    folder, rows = shared_folder(spark, "near-duplicates"), _identified(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInArrow(_signatures, f"doc_id {kind}, tk binary, rk long, size long, buckets array<bigint>, sketch binary")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("least")
    texts = signed.groupBy("tk").agg(least, F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"))
    texts = written(texts.select("tk", F.col("least.doc_id").alias("first_id"), F.col("least.rk").alias("rk"), "size", "buckets", "sketch"), f"{folder}/texts")

    buckets = texts.select("tk", "size", F.posexplode("buckets").alias("band", "bucket"))
    several = written(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), f"{folder}/buckets")
    members = written(buckets.join(several, "bucket"), f"{folder}/members")

    company = members.groupBy("tk").agg(F.sum("n").alias("company"))
    centres = members.join(company, "tk").groupBy("bucket").agg(F.max(F.struct("company", "tk", "size")).alias("c"))
    centres = written(centres.select("bucket", F.col("c.tk").alias("centre"), F.col("c.size").alias("width")), f"{folder}/centres")
    cell = F.xxhash64("centre").alias("cell")
    around = members.join(centres, "bucket").filter("tk <> centre").select(cell, F.lit(0).alias("band"), "tk", F.col("tk").alias("root"), "size").distinct()
    middle = centres.select(cell, F.lit(0).alias("band"), F.col("centre").alias("tk"), F.col("centre").alias("root"), F.col("width").alias("size")).distinct()
    roots = connected(_met(around, middle, texts, rows, similarity, f"{folder}/centred"), f"{folder}/components-1")

    placed = members.join(roots.withColumnRenamed("node", "tk"), "tk", "left").select(F.col("bucket").alias("cell"), "band", "tk", F.coalesce("root", "tk").alias("root"), "size")
    placed = written(placed, f"{folder}/placed")
    largest = placed.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("components"))
    largest = written(largest.filter("components > 1").select("cell", F.col("m.root").alias("largest")), f"{folder}/mixed")
    mixed = placed.join(largest, "cell")
    links = _met(mixed.select(*placed.columns), mixed.filter("root <> largest").select(*placed.columns), texts, rows, similarity, f"{folder}/mixed-cells")
    roots = connected(links, f"{folder}/components-2", roots)

    named = texts.select("tk", "first_id", "rk").join(roots.withColumnRenamed("node", "tk"), "tk", "left").select("tk", "first_id", "rk", F.coalesce("root", "tk").alias("root"))
    heads = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), "first_id", "tk")).alias("m")).select("root", F.col("m.first_id").alias("class_id"), F.col("m.tk").alias("class_tk"))
    return named.join(heads, "root").select("tk", "first_id", "rk", "class_id", "class_tk")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: doc_id, class_id (the class's smallest id), kept (it stands for its class)."""
    rows = _identified(docs, id_col, text_col).select("doc_id", "tk")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tk") == F.col("class_tk"))
    return rows.join(classes(docs, id_col, text_col, similarity), "tk").select("doc_id", "class_id", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, the same columns: its smallest id, one row if that is repeated whole."""
    names, text = docs.columns, F.coalesce(F.col(text_col), F.lit(""))
    found = classes(docs, id_col, text_col, similarity).filter("tk = class_tk").select("tk", "rk")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("r"), *_keys(text, id_col))
    kept = rows.join(found, ["rk", "tk"])
    # Of rows that repeat whole one stays.
    times = rows.groupBy("rk").agg(F.count("*").alias("times")).filter("times > 1").select("rk", F.lit(True).alias("again"))
    kept = kept.join(times, "rk", "left")
    once = kept.filter("again IS NULL").select("r")
    one = kept.filter("again").groupBy("rk", "tk").agg(F.first("r").alias("r")).select("r")
    return once.unionByName(one).select(*(F.col("r")[c].alias(c) for c in names))
