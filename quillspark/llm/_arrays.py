"""Vectorised text kernels over Arrow string columns.

A column is viewed as one byte array plus document offsets, never as Python
strings.  Words are maximal runs of bytes accepted by a 256-entry table, and
word and shingle fingerprints are differences of prefix sums of a polynomial
modulo 2**64, finished with a bit mixer.  All kernels run over bounded slices
of documents (:func:`slices`), so memory follows the slice, not the column.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by the numpy kernels (one longer document is one slice).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD1342543DE82EF95 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _random_bytes_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = _random_bytes_table()
_BYTE_VALUE_LOWER = _BYTE_VALUE[_LOWER]

#: Words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WINDOW_BASE)


@dataclass
class Words:
    """Words of a slice of documents; ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    doc_start: np.ndarray  # byte offsets, one more than documents
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.per_doc)

    def word(self, i: int, lower: bool = False) -> bytes:
        w = self.data[self.start[i] : self.end[i]].tobytes()
        return w.lower() if lower else w

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One mixed 64-bit fingerprint per word; bytes A-Z count as a-z if lower."""
        up, down = _BYTE_POWERS.get(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        value = (_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[self.data]
        value *= up[: len(self.data)]
        np.cumsum(value, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most ``limit`` bytes, one document at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of documents given as bytes and offsets; no word crosses a document."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = table[data]
    begin, finish = inside[:n].copy(), inside[:n].copy()
    begin[1:] &= ~inside[: n - 1] if n else begin[1:]
    finish &= ~inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begin[edge] = inside[edge]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    finish[last] = inside[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def column_words(column: pa.Array, table: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(a, b, words) for slices [a, b) of the documents of a column."""
    data, offsets = string_parts(column)
    for a, b in slices(offsets, limit):
        yield a, b, split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)


def window_hashes(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` values inside one document, and where they start."""
    n = len(values)
    if n < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    up, down = _WORD_POWERS.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    counts = np.diff(first)
    room = np.repeat(first[1:], counts)[: n - size + 1] - np.arange(n - size + 1)
    at = np.flatnonzero(room >= size)
    return mix((total[at + size] - total[at]) * down[at]), at


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(kernel: Kernel) -> Kernel:
    """The kernel, giving freed memory back to the machine behind each task: workers are used again."""

    @wraps(kernel)
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(rows)
        finally:
            release()

    return run


def release() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` rows."""
    for b in rows:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)
