"""Interpolated modified Kneser-Ney trigram model: counted in Spark, mapped by workers.

Counting moves packed arrays, not rows: a task sums what it has read into
sorted arrays, cuts them by key range into shards and sends one row per
shard; a shard's task merges them.  The number of shards follows the number of tokens
(``SHARD_TOKENS``).  The model is stored in the shared folder:

* vocabulary shards: sorted 64-bit word hashes and counts; a word's id is its
  rank over all shards;
* bigram shards: sorted keys of (id, id), with how many distinct words come before the
  pair and how often it occurs;
* trigram shards, in the order of their last two words: the word before each pair and the count.
  They stay in the task that counts them;
* context shards, in the order of the bigrams: how many words follow the pair once, twice, more often,
  counted over the stored trigrams; of a pair that occurs once it is known without;
* statistics by id range: how many pairs a word begins by how many words come before them, and
  how many distinct words come before it.

A key of ids is a bijection onto as many bits as the vocabulary needs, so nothing collides.  Shards
are cut by keys of pairs, so a frequent word's pairs spread over all of them and its statistics
are sums of partial counts.  All counts have 64 bits; files hold small ones in a byte and the others beside.
Workers memory-map the files: only pages that a batch looks up are read.

Probabilities: discounts D1, D2, D3+ from counts of counts on each level.  Trigrams are discounted by
their counts and interpolated with bigrams, these, by continuation counts (how many words come
before them), with words by continuation counts, and those with the uniform distribution over the
vocabulary and one unknown word.  All trigrams are stored.  A caller may ask for those of ``least``
occurrences only; then the others enter totals, counts of counts and continuation counts, and their
share goes to the bigram with what the discounts leave.
Texts begin in a start state of two places and close with an end token.

Defined cases: null text is empty (its end token only); null ids train; without
training rows every probability is the uniform one; repeated rows count each;
an empty table gives no rows; only the named columns are read.  A text is worked on
whole, so the longest one must fit a task several times over.  Ids are 32 bits wide;
a larger vocabulary is refused.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._arrays import NOT_SPACE, Words, column_words, mix, trimmed
from quillspark.llm._store import discard, forget_shuffles, mapped, put, shared_folder, written

SMOOTH = 0.1
#: The end token; no word has no bytes.
END_HASH = mix(np.array([0x5EED], dtype=np.uint64))[0]
#: (key, count) pairs that a task holds before it sends or merges them.
HELD = 1 << 21
#: Tokens of training text to a shard, and the smallest count of a stored trigram (1 stores all).
SHARD_TOKENS, LEAST = 1 << 22, 1
#: Bytes of text counted at once; scoring holds more numbers a token and takes half.
_SLICE = 1 << 22
BLOB = "shard int, keys binary, counts binary"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Monotone in the key, and even for hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _blobs(keys: np.ndarray, counts: np.ndarray, shards: int, hashed: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(hashed(keys))
    keys, counts = keys[order], counts[order].astype("<u8")
    cut = np.searchsorted(shard_of(hashed(keys), shards), np.arange(shards + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([keys[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary()), pa.array([counts[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary())], ["shard", "keys", "counts"])


def _counting(keys_of: Callable[[Words], np.ndarray], shards: int, hashed: Callable[[np.ndarray], np.ndarray] = lambda k: k):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in rows:
            for _, _, words in column_words(batch.column(0), NOT_SPACE, _SLICE):
                k, c = np.unique(keys_of(words), return_counts=True)
                keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, c]))
                if len(keys) > HELD:
                    yield _blobs(keys, counts, shards, hashed)
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield _blobs(keys, counts, shards, hashed)

    return run


def _by_shard(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merged (keys, counts) of each shard of rows sorted by shard."""
    at, keys, counts, held = None, [], [], 0

    def close() -> tuple[int, np.ndarray, np.ndarray]:
        k, c = merged(np.concatenate(keys), np.concatenate(counts))
        return at, k, c

    for batch in rows:
        for shard, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if shard != at:
                if keys:
                    yield close()
                at, keys, counts, held = shard, [], [], 0
            keys.append(np.frombuffer(k.as_buffer(), dtype=np.uint64))
            counts.append(np.frombuffer(c.as_buffer(), dtype="<u8").astype(np.int64))
            held += len(keys[-1])
            if held > HELD:  # so that many tasks' arrays are not held one beside another
                _, k1, c1 = close()
                keys, counts, held = [k1], [c1], 0
    if keys:
        yield close()


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with an end token after each document; the documents' bounds in them."""
    bounds = words.first + np.arange(words.n_docs + 1)
    out = np.full(bounds[-1], END_HASH, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[bounds[1:] - 1] = False
    out[inner] = words.hashes(lower=True)
    return out, bounds


@dataclass
class Shards:
    """Sorted keys and counts in files by key range; base: the rank of each shard's first key."""

    folder: str
    base: np.ndarray

    def __post_init__(self) -> None:
        self.files = Files(self.folder, ("<u8", *SMALL))

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "base": self.base}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, count or 0) of each key, looked up in sorted order."""
        known, code = np.unique(keys, return_inverse=True)
        rank, count = np.full(len(known), -1, dtype=np.int64), np.zeros(len(known), dtype=np.int64)
        n = len(self.base) - 1
        cut = np.searchsorted(shard_of(known, n), np.arange(n + 1))
        for s in np.flatnonzero(np.diff(cut)):
            if self.base[s + 1] == self.base[s]:
                continue
            have, *counts = self.files[int(s)]
            part = known[cut[s] : cut[s + 1]]
            i = np.minimum(np.searchsorted(have, part), len(have) - 1)
            hit = have[i] == part
            rank[cut[s] : cut[s + 1]] = np.where(hit, i + self.base[s], -1)
            count[cut[s] : cut[s + 1]] = np.where(hit, _large(*counts, i), 0)
        return rank[code], count[code]


def _put_shard(folder: str, s: int, keys: np.ndarray, counts: np.ndarray) -> None:
    _put_arrays(f"{folder}/{s}", keys, *_small(counts))


class Pairing:
    """Pairs of ids as numbers of ``width`` bits in mixed order: a bijection."""

    _ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

    def __init__(self, n_ids: int) -> None:
        self.bits = max(20, int(n_ids).bit_length())
        self.width = 2 * self.bits
        self.mask, self.low = np.uint64((1 << self.width) - 1), np.uint64((1 << self.bits) - 1)

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a.astype(np.uint64) << np.uint64(self.bits)) | b.astype(np.uint64)
        for odd in self._ODD:
            x = (x * np.uint64(odd)) & self.mask
            x ^= x >> np.uint64(self.bits)
        return x

    def ids(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for odd in reversed(self._ODD):
            x = x ^ (x >> np.uint64(self.bits))
            x = (x * np.uint64(pow(odd, -1, 1 << 64))) & self.mask
        return (x >> np.uint64(self.bits)).astype(np.int64), (x & self.low).astype(np.int64)

    def shard(self, keys: np.ndarray, shards: int) -> np.ndarray:
        """Monotone in the key."""
        return ((keys >> np.uint64(self.width - 32)) * np.uint64(shards)) >> np.uint64(32)

    def first(self, shard: int, shards: int) -> int:
        """The smallest key that a shard may hold."""
        return -(-(shard << 32) // shards) << (self.width - 32)


def before(ids: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before; the start state before a text."""
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[bounds[:-1]] = two[bounds[:-1]] = start
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = start
    return one, two


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a number, the numbers' bytes with equal places together, which compresses)."""
    wide = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return wide, np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _numbers(wide: int, n: int, raw: bytes) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :wide] = np.frombuffer(raw, dtype=np.uint8).reshape(wide, n).T
    return out.reshape(-1).view("<u8")


class Triples:
    """Sorted (key of a pair, id before it) with counts."""

    def __init__(self, keys: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((heads, keys))
        keys, heads, counts = keys[order], heads[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (heads[1:] != heads[:-1])])[: len(keys)])
        self.keys, self.heads = keys[new], heads[new]
        self.counts = np.add.reduceat(counts, new) if len(new) else counts

    def __len__(self) -> int:
        return len(self.keys)

    def packed(self, a: int, b: int) -> bytes:
        """Triples a to b: differences of keys, heads, and the counts that are not 1."""
        keys, many = self.keys[a:b], np.flatnonzero(self.counts[a:b] != 1)
        (w, steps), (v, heads) = _planes(np.diff(keys, prepend=keys[0])), _planes(self.heads[a:b])
        top = np.array([b - a, int(keys[0]), w, v, len(many)], dtype="<u8").tobytes()
        return b"".join([top, steps, heads, many.astype("<u4").tobytes(), self.counts[a:b][many].astype("<u8").tobytes()])

    @staticmethod
    def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, first, w, v, m = (int(x) for x in np.frombuffer(raw[:40], dtype="<u8"))
        at = 40 + w * n
        keys = np.cumsum(_numbers(w, n, raw[40:at])) + np.uint64(first)
        heads, counts = _numbers(v, n, raw[at : at + v * n]).astype(np.int64), np.ones(n, dtype=np.int64)
        at += v * n
        counts[np.frombuffer(raw[at : at + 4 * m], dtype="<u4")] = np.frombuffer(raw[at + 4 * m :], dtype="<u8")
        return keys, heads, counts

    @staticmethod
    def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Triples:
        return Triples(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one byte each, places of those over 254, their values)."""
    over = np.flatnonzero(x > 254)
    return np.minimum(x, 255).astype(np.uint8), over.astype("<u8"), x[over].astype("<u8")


def _large(small: np.ndarray, over: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = small[at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = values[np.searchsorted(over, at[big])]
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The numbers' bytes, as many each as the largest needs, and eight more, so that each can be read as a long one."""
    wide = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    out = np.zeros(len(x) * wide + 8, dtype=np.uint8)
    out[: len(x) * wide].reshape(-1, wide)[:] = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
    return out


def _widened(raw: np.ndarray, n: int, at: np.ndarray | slice) -> np.ndarray:
    """Those at some places of ``n`` numbers that :func:`_narrow` wrote."""
    wide = (len(raw) - 8) // n
    return (np.ndarray((n,), "<u8", raw, 0, (wide,))[at] & np.uint64((1 << 8 * wide) - 1)).view(np.int64)


def _arrays(raw: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a file that begins with their lengths."""
    sizes, at, out = raw[: 8 * len(kinds)].view("<u8"), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        step = n * np.dtype(kind).itemsize
        out.append(raw[at : at + step].view(kind))
        at += -(-step // 8) * 8
    return out


def _put_arrays(uri: str, *arrays: np.ndarray) -> None:
    parts = [np.array([len(a) for a in arrays], dtype="<u8")]
    for a in arrays:
        whole = np.zeros(-(-a.nbytes // 8) * 8, dtype=np.uint8)
        whole[: a.nbytes] = np.ascontiguousarray(a).view(np.uint8)
        parts.append(whole)
    put(uri, *parts)


@dataclass
class Files:
    """Mapped files of a folder, opened when they are asked for."""

    folder: str
    kinds: tuple[str, ...]

    def __post_init__(self) -> None:
        self.open: dict[int, list[np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "kinds": self.kinds, "open": {}}

    def __getitem__(self, k: int) -> list[np.ndarray]:
        if k not in self.open:
            self.open[k] = _arrays(np.asarray(mapped(f"{self.folder}/{k}", np.uint8)), self.kinds)
        return self.open[k]


#: Numbers of which most are small: a byte each, places of those over 254, their values.
SMALL = ("u1", "<u8", "<u8")
#: Bigram files: where each range of keys begins, and its trigrams; the keys' low bits; words before the pair, occurrences, stored trigrams (empty: as many as words before).
PAIR_FILE = ("u1", "u1", "u1", *SMALL * 3)
#: Trigram files, in the order of the bigrams: first words, sorted for each pair; counts.
TRIPLE_FILE = ("u1", *SMALL)
#: Context files, in the order of the bigrams up to the last that occurs twice: stored trigrams that begin with the pair and occur once, twice, more often; their sum (empty: the pair's occurrences).
CONTEXT_FILE = SMALL * 4
#: Statistics files: five numbers of each word of an id range.
STATS_FILE = SMALL * 5


def _cut(pairing: Pairing, shards: int, n: int) -> tuple[int, int]:
    """(bits of a key within a shard, bits of them that choose a range of a few keys)."""
    inner = ((1 << pairing.width) // shards + (1 << (pairing.width - 32))).bit_length()
    return inner, min(inner, max(inner - 32, n.bit_length() - 2, 0))


def _put_pairs(folder: str, pairing: Pairing, shards: int, s: int, keys: np.ndarray, before_: np.ndarray, times: np.ndarray, stored: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> None:
    """A shard's pairs, and the heads and counts of their stored trigrams."""
    inner, top = _cut(pairing, shards, len(keys))
    local = keys - np.uint64(pairing.first(s, shards))
    ranges = np.searchsorted(local >> np.uint64(inner - top), np.arange((1 << top) + 1, dtype=np.uint64))
    firsts = np.concatenate([[0], np.cumsum(stored)])[ranges]
    low = local & np.uint64((1 << (inner - top)) - 1)
    own = stored if (stored != before_).any() else stored[:0]
    _put_arrays(f"{folder}/pairs/{s}", _narrow(ranges), _narrow(firsts), _narrow(low), *_small(before_), *_small(times), *_small(own))
    _put_arrays(f"{folder}/triples/{s}", _narrow(heads), *_small(counts))


@dataclass
class Pairs:
    """Bigram files, cut by key range into shards."""

    pairing: Pairing
    shards: int
    files: Files

    def by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        cut = np.searchsorted(self.pairing.shard(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            yield int(s), slice(cut[s], cut[s + 1])

    def places(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of sorted keys, by shard: those that are there, their places, and where their trigrams begin."""
        for s, part in self.by_shard(keys):
            ranges, firsts, low, *_ = self.files[s]
            _, stored = self.counts(s)[1:]
            n = len(stored[0])
            if not n:
                continue
            inner, top = _cut(self.pairing, self.shards, n)
            local = keys[part] - np.uint64(self.pairing.first(s, self.shards))
            want, r = (local & np.uint64((1 << (inner - top)) - 1)).astype(np.int64), (local >> np.uint64(inner - top)).astype(np.int64)
            at, end, first = _widened(ranges, (1 << top) + 1, r), _widened(ranges, (1 << top) + 1, r + 1), _widened(firsts, (1 << top) + 1, r)
            left, there = np.flatnonzero(at < end), np.zeros(len(at), dtype=bool)
            while len(left):  # ranges hold a few keys
                hit = _widened(low, n, at[left]) == want[left]
                there[left[hit]] = True
                left = left[~hit]
                first[left] += _large(*stored, at[left])
                at[left] += 1
                left = left[at[left] < end[left]]
            found = np.flatnonzero(there)
            yield s, part.start + found, at[found], first[found]

    def counts(self, s: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Words before a shard's pairs, occurrences, stored trigrams."""
        counts = self.files[s][3:]
        return counts[:3], counts[3:6], counts[6:] if len(counts[6]) else counts[:3]

    def keys(self, s: int) -> np.ndarray:
        ranges, _, low, small, *_ = self.files[s]
        inner, top = _cut(self.pairing, self.shards, len(small))
        high = np.repeat(np.arange(1 << top, dtype=np.uint64), np.diff(_widened(ranges, (1 << top) + 1, slice(None))))
        return ((high << np.uint64(inner - top)) | _widened(low, len(small), slice(None)).astype(np.uint64)) + np.uint64(self.pairing.first(s, self.shards))


def _put_contexts(folder: str, s: int, t: Triples, whole: bool) -> None:
    """What follows a shard's pairs: keys are their places, heads the kinds of sums; ``whole``: all trigrams are stored."""
    sums = np.zeros((4, int(t.keys.max(initial=np.uint64(0))) + 1 if len(t) else 0), dtype=np.int64)
    sums[t.heads, t.keys.astype(np.int64)] = t.counts
    _put_arrays(f"{folder}/contexts/{s}", *(a for x in (*sums[:3], sums[3, :0] if whole else sums[3]) for a in _small(x)))


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney from how many keys have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    own = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.clip(own, 0.05, [0.95, 1.9, 2.85])


@dataclass
class Model:
    vocabulary: Shards
    pairing: Pairing
    pairs: Pairs
    triples: Files
    contexts: Files
    stats: Files
    n_tokens: int
    n_docs: int
    n_pairs: int  # distinct
    d_three: np.ndarray
    d_two: np.ndarray
    d_one: np.ndarray
    low: np.ndarray  # words by continuation count: 1, 2, 3+
    whole: bool  # all trigrams are stored
    begin: np.ndarray  # stored trigrams at the start of a text that occur once, twice, more often; their sum
    span: int  # ids in a statistics file

    @property
    def n_types(self) -> int:
        return int(self.vocabulary.base[-1])

    def statistics(self, ids: np.ndarray) -> np.ndarray:
        """Rows (pairs it begins with 1, 2, more words before them; all those words; words before it) for ids; the start state has the last."""
        known, code = np.unique(ids, return_inverse=True)
        out, cut = np.zeros((len(known), 5), dtype=np.int64), np.searchsorted(known, np.arange(0, self.n_types + 1 + self.span, self.span))
        for r in np.flatnonzero(np.diff(cut)):
            columns, at = self.stats[int(r)], known[cut[r] : cut[r + 1]] - r * self.span
            for k in range(5):
                out[cut[r] : cut[r + 1], k] = _large(*columns[3 * k : 3 * k + 3], at)
        return out[code]

    def find_pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words before, occurrences, stored trigrams and where they begin) of pairs, 0 if they are not there; what the discounts leave of the trigrams behind them."""
        known, code = np.unique(keys, return_inverse=True)
        out, kept = np.zeros((4, len(known)), dtype=np.int64), np.zeros(len(known))
        for s, rows, at, first in self.pairs.places(known):
            ahead, times, stored = self.pairs.counts(s)
            total = _large(*times, at)
            out[:, rows] = _large(*ahead, at), total, _large(*stored, at), first
            if self.whole:  # the word behind a pair that occurs once occurs there once
                kept[rows] = (total == 1) * (1 - self.d_three[0])
            columns = self.contexts[s]
            more = np.flatnonzero((total > 1) & (at < len(columns[0])))
            if len(more):
                sums = [_large(*columns[3 * k : 3 * k + 3], at[more]) for k in range(3)]
                kept[rows[more]] = (total[more] if self.whole else _large(*columns[9:], at[more])) - sum(d * n for d, n in zip(self.d_three, sums, strict=True))
        return out[:, code], kept[code]

    def find_triples(self, keys: np.ndarray, first: np.ndarray, size: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Counts of (head, pair), or 0; a pair has ``size`` stored trigrams from ``first`` on."""
        order, out = np.argsort(keys, kind="stable"), np.zeros(len(keys), dtype=np.int64)
        for s, part in self.pairs.by_shard(keys[order]):
            raw, *counts = self.triples[s]
            rows, n = order[part], len(counts[0])
            want, low = heads[rows], first[rows]
            end = low + size[rows]
            high, left = end.copy(), np.flatnonzero(low < end)
            while len(left):  # halves of what is left
                middle = (low[left] + high[left]) >> 1
                less = _widened(raw, n, middle) < want[left]
                low[left[less]], high[left[~less]] = middle[less] + 1, middle[~less]
                left = left[low[left] < high[left]]
            hit = np.flatnonzero(low < end)
            if len(hit):
                hit = hit[_widened(raw, n, low[hit]) == want[hit]]
                out[rows[hit]] = _large(*counts, low[hit])
        return out

    def log10(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 probability, id or -1, and training count."""
        ids, counts = self.vocabulary.find(hashes)
        uniform, start = 1.0 / (self.n_types + 1), self.n_types
        if not self.n_types:
            return np.full(len(ids), np.log10(uniform)), ids, counts
        one, two = before(ids, bounds, start)
        known = ids >= 0
        stats = self.statistics(np.maximum(np.concatenate([ids, one]), 0))
        cont, context = stats[: len(ids), 4] * known, stats[len(ids) :, :4] * (one >= 0)[:, None]
        p = (cont - self.d_one[np.clip(cont - 1, 0, 2)] * (cont > 0)) / self.n_pairs + float(self.d_one @ self.low) / self.n_pairs * uniform

        (pair, times, stored, first), behind = np.zeros((4, len(ids)), dtype=np.int64), np.zeros(len(ids))
        ask = np.flatnonzero(known & (one >= 0))
        (pair[ask], times[ask], stored[ask], first[ask]), behind[ask] = self.find_pairs(self.pairing.key(one[ask], ids[ask]))
        n = np.maximum(context[:, 3], 1)
        two_words = (pair - self.d_two[np.clip(pair - 1, 0, 2)] * (pair > 0)) / n + (context[:, :3] @ self.d_two) / n * p
        p = np.where(context[:, 3] > 0, two_words, p)

        # A context is the pair that ends one place before, or the start of a text.
        seen, kept = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
        seen[1:], kept[1:] = times[:-1], behind[:-1]
        seen[bounds[:-1]], kept[bounds[:-1]] = self.n_docs, self.begin[3] - self.d_three @ self.begin[:3]
        ask = np.flatnonzero((seen > 0) & (stored > 0))
        times3 = np.zeros(len(ids), dtype=np.int64)
        times3[ask] = self.find_triples(self.pairing.key(one[ask], ids[ask]), first[ask], stored[ask], two[ask])
        n = np.maximum(seen, 1)
        three = (times3 - self.d_three[np.clip(times3 - 1, 0, 2)] * (times3 > 0)) / n + (1 - kept / n) * p
        return np.log10(np.where(seen > 0, three, p)), ids, counts


def train(docs: DataFrame, text_col: str = "text", shards: int | None = None, least: int = LEAST) -> Model:
    """Count and store the model; the driver sees a few numbers per shard."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, texts = shared_folder(spark, "lm"), docs.select(F.col(text_col).alias("text"))
    vocabulary, n_tokens, n_docs = _vocabulary(texts, folder, shards or tasks)
    n_types = int(vocabulary.base[-1])
    if n_types >= (1 << 32) - 2:
        raise ValueError("more than 2**32 - 3 distinct words")
    shards = shards or max(tasks, -(-n_tokens // SHARD_TOKENS))
    forget_shuffles(spark)
    pairing, span = Pairing(n_types + 1), -(-(n_types + 1) // shards)
    sums = _triples(spark, texts, folder, shards, vocabulary, pairing, span, least)
    begin = np.append(sums["begin"][:3], n_docs if least <= 1 else sums["begin"][3])
    low = np.array([sums["one"][0], sums["one"][1], sums["types"] - sums["one"][0] - sums["one"][1]], dtype=np.float64)
    pairs = Pairs(pairing, shards, Files(f"{folder}/pairs", PAIR_FILE))
    files = (Files(f"{folder}/{what}", kinds) for what, kinds in (("triples", TRIPLE_FILE), ("contexts", CONTEXT_FILE), ("stats", STATS_FILE)))
    return Model(vocabulary, pairing, pairs, *files, n_tokens, n_docs, max(1, sums["pairs"]), discounts(sums["three"]), discounts(sums["two"]), discounts(sums["one"]), low, least <= 1, begin, span)


def _vocabulary(texts: DataFrame, folder: str, shards: int) -> tuple[Shards, int, int]:
    @trimmed
    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, counts in _by_shard(rows):
            _put_shard(f"{folder}/words", s, keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())]), pa.array([int(counts[keys == END_HASH].sum())])], ["shard", "types", "tokens", "docs"])

    blobs = texts.mapInArrow(_counting(lambda w: _tokens(w)[0], shards), BLOB)
    rows = blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, types long, tokens long, docs long").collect()
    sizes = np.zeros(shards, dtype=np.int64)
    for r in rows:
        sizes[r.shard] = r.types
    return Shards(f"{folder}/words", np.concatenate([[0], np.cumsum(sizes)])), sum(r.tokens for r in rows), sum(r.docs for r in rows)


_NUMBERS, _SHARE, _CONTEXT = 0, 1, 2
_PART = "kind int, part int, body binary"


def _parts(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "part", "body"])


def _joined(pieces: list[bytes]) -> bytes:
    return np.array([len(pieces), *map(len, pieces)], dtype="<u8").tobytes() + b"".join(pieces)


def _pieces(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(raw[8 : 8 * (n + 1)], dtype="<u8").astype(np.int64)])
    return [raw[a:z] for a, z in itertools.pairwise(ends)]


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _triples(spark: SparkSession, texts: DataFrame, folder: str, shards: int, vocabulary: Shards, pairing: Pairing, span: int, least: int) -> dict:
    shared = spark.sparkContext.broadcast(vocabulary)  # two numbers per shard; files are mapped
    n_types = int(vocabulary.base[-1])
    edges = np.arange(0, n_types + 1 + span, span)
    none = np.zeros(0, dtype=np.int64)
    nothing = none.astype(np.uint64), none, none
    pairs, triples = Pairs(pairing, shards, Files(f"{folder}/pairs", PAIR_FILE)), Files(f"{folder}/triples", TRIPLE_FILE)

    def send(t: Triples) -> pa.RecordBatch:
        cut = np.searchsorted(pairing.shard(t.keys, shards), np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([t.packed(cut[s], cut[s + 1]) for s in some], pa.binary())], ["shard", "body"])

    @trimmed
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in rows:
            for _, _, words in column_words(batch.column(0), NOT_SPACE, _SLICE):
                hashes, bounds = _tokens(words)
                ids = shared.value.find(hashes)[0]
                one, two = before(ids, bounds, n_types)
                held.append((pairing.key(one, ids), two, np.ones(len(ids), dtype=np.int64)))
                if sum(len(h[0]) for h in held) > HELD:
                    t = Triples.joined(held)
                    held = [(t.keys, t.heads, t.counts)]
                    if len(t) > HELD // 2:
                        yield send(t)
                        held = []
        if held:
            yield send(Triples.joined(held))

    def partial(s: int, t: Triples) -> Iterator[pa.RecordBatch]:
        """Stores a shard's pairs and trigrams; sends its numbers and its share of words' statistics."""
        first = np.flatnonzero(np.concatenate([[True], t.keys[1:] != t.keys[:-1]]))
        keys, ahead, times = t.keys[first], np.diff(np.append(first, len(t))), np.add.reduceat(t.counts, first)
        keep = t.counts >= least
        stored, heads, counts = np.add.reduceat(keep.astype(np.int64), first), t.heads[keep], t.counts[keep]
        _put_pairs(folder, pairing, shards, s, keys, ahead, times, stored, heads, counts)
        b, c = pairing.ids(keys)
        begin = counts[(heads == n_types) & (np.repeat(b, stored) == n_types)]  # at the start of a text, which is no pair
        rows = [(_NUMBERS, s, np.array([len(keys), *_of_counts(t.counts), *_of_counts(ahead), *((begin == k).sum() for k in (1, 2)), (begin > 2).sum(), begin.sum()], dtype="<i8").tobytes())]
        one = np.ones(len(keys), dtype=np.int64)
        shares: list[list[bytes]] = [[b""] * 5 for _ in range(shards)]
        for kind, (at, n) in enumerate(((b[ahead == 1], one[ahead == 1]), (b[ahead == 2], one[ahead == 2]), (b[ahead > 2], one[ahead > 2]), (b, ahead), (c, one))):
            ids, sums = merged(at, n)
            cut = np.searchsorted(ids, edges)
            for r in np.flatnonzero(np.diff(cut)):
                (w, i), (v, x) = _planes(ids[cut[r] : cut[r + 1]] - r * span), _planes(sums[cut[r] : cut[r + 1]])
                shares[r][kind] = bytes([w, v]) + i + x
        yield _parts(rows + [(_SHARE, k, _joined(share)) for k, share in enumerate(shares) if any(share)])

    @trimmed
    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in rows:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != at:
                    if held:
                        yield from partial(at, Triples.joined(held))
                    at, held = shard, []
                held.append(Triples.unpacked(body.as_buffer().to_pybytes()))
                if len(held) > 1 and sum(len(h[0]) for h in held) > 2 * max(HELD, len(held[0][0])):
                    t = Triples.joined(held)
                    held = [(t.keys, t.heads, t.counts)]
        if held:
            yield from partial(at, Triples.joined(held))

    @trimmed
    def follow(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a shard's trigrams add to the contexts that occur twice or more, by place among the pairs."""
        for s in itertools.chain.from_iterable(b.column(0).to_pylist() for b in rows):
            raw, *small = triples[s]
            n = len(small[0])
            if not n:
                continue
            _, _, stored = pairs.counts(s)
            b, _ = pairing.ids(pairs.keys(s))
            contexts = pairing.key(_widened(raw, n, slice(None)), np.repeat(b, _large(*stored, np.arange(len(b)))))
            order = np.argsort(contexts)
            contexts, counts = contexts[order], _large(*small, order)
            first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
            size = np.diff(np.append(first, n))
            for k, found, at, _ in pairs.places(contexts[first]):
                more = _large(*pairs.counts(k)[1], at) > 1
                found, at = found[more], at[more].astype(np.uint64)
                if not len(found):
                    continue
                # Trigrams of the contexts, one group after another.
                each, ends = size[found], np.cumsum(size[found])
                own = counts[np.arange(ends[-1]) + np.repeat(first[found] - ends + each, each)]
                place = np.repeat(at, each)
                groups = [(place, np.minimum(own, 3) - 1, np.ones(len(own), dtype=np.int64))]
                if least > 1:
                    groups.append((place, np.full(len(own), 3), own))
                t = Triples.joined(groups)
                yield _parts([(_CONTEXT, k, t.packed(0, len(t)))])

    @trimmed
    def store(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch:
            kind, part = at
            numbers = []
            if kind == _CONTEXT:
                _put_contexts(folder, part, Triples.joined([Triples.unpacked(x) for x in held]), least <= 1)
            else:
                sums = np.zeros((span, 5), dtype=np.int64)
                for own, column in enumerate(zip(*map(_pieces, held), strict=True)):
                    for x in filter(None, column):
                        w, v = x[:2]
                        n = (len(x) - 2) // (w + v)
                        sums[_numbers(w, n, x[2 : 2 + w * n]).astype(np.int64), own] += _numbers(v, n, x[2 + w * n :]).astype(np.int64)
                _put_arrays(f"{folder}/stats/{part}", *(a for k in range(5) for a in _small(sums[:, k])))
                numbers = [*_of_counts(sums[:, 4]), int((sums[:, 4] > 0).sum())]
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([numbers], pa.list_(pa.int64()))], ["kind", "part", "numbers"])

        for batch in rows:
            for kind, part, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (kind, part) != at:
                    if held:
                        yield close()
                    at, held = (kind, part), []
                held.append(body)
        if held:
            yield close()

    # Written, so that all pairs are there when contexts are counted, and the trigrams' shuffle files can go.
    parts = written(texts.mapInArrow(count, "shard int, body binary").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, _PART), f"{folder}/parts")
    counted = {r.part: np.frombuffer(r.body, dtype="<i8") for r in parts.filter(F.col("kind") == _NUMBERS).collect()}
    for s in {*range(shards)} - {*counted}:
        _put_pairs(folder, pairing, shards, s, *nothing, none, none, none)
    forget_shuffles(spark)
    contexts = spark.range(0, shards, 1, shards).mapInArrow(follow, _PART)
    rows = parts.filter(F.col("kind") == _SHARE).unionByName(contexts).repartition(shards, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(store, "kind int, part int, numbers array<bigint>").collect()
    discard(spark, f"{folder}/parts")
    for s in {*range(shards)} - {r.part for r in rows if r.kind == _CONTEXT}:
        _put_contexts(folder, s, Triples(*nothing), least <= 1)
    numbers = np.sum([*counted.values()] or [[0] * 13], axis=0)
    words = np.sum([r.numbers for r in rows if r.kind == _SHARE] or [[0] * 5], axis=0)
    return {"pairs": int(numbers[0]), "three": numbers[1:5], "two": numbers[5:9], "begin": numbers[9:], "one": words[:4], "types": int(words[4])}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            parts = []
            for _, _, words in column_words(batch.column(1), NOT_SPACE, _SLICE // 2):
                hashes, bounds = _tokens(words)
                logs, ids, counts = m.log10(hashes, bounds)
                base = np.log10((counts + SMOOTH) / (m.n_tokens + SMOOTH * (m.n_types + 1)))
                at = bounds[:-1]
                parts.append((np.diff(bounds), np.add.reduceat((ids >= 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)))
            if not parts:
                continue
            n, known, base, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), m.n_tokens, dtype=np.int64)), pa.array(base), pa.array(logs), pa.array(10.0 ** np.minimum(300, -logs / n))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
