"""Token counts from distinct pre-tokens, without materialising ids.

Documents are normalised and pre-tokenised in chunks (one Arrow batch of one
task).  A chunk emits one row per distinct pre-token with its postings: which
documents of the chunk hold it and how often, as packed integers.  The rows meet by
pre-token; pieces are counted once for each distinct one, and the count is
joined to all its postings in the same pass.  Sums per chunk leave each
partition as one row per chunk, and a last merge by chunk adds them up per document.
Shuffled data are a few bytes per (pre-token, document) pair and no ids exist.

Skew: a pre-token, however frequent, gives at most one row per chunk, and those that
are entries of the vocabulary file (a fixed table) are counted where they stand and
never shuffled, so no frequent word makes a hot key.

The pre-tokens are those of the tokenizer file.  Texts of characters below
U+0250 are split by an equivalent regular expression, others by the library's own
normaliser and pre-tokeniser.  Special strings inside a text count as the library
counts them by default: one token each.

Defined cases: null text is empty (0 bytes, 0 tokens); repeated rows are counted
each; an empty table gives no rows; a very long text is one document of its
chunk; only the named columns are read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrays import batches, string_parts

#: Documents in a chunk, at most.
CHUNK = 2048
LIMIT = 2048
_BEYOND = re.compile("[^\x00-ɏ]")

MESSAGE = "token string, task int, batch int, body binary"


class PreTokenizer:
    """Pre-tokens of a ``tokenizers`` file and the number of pieces of each."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        """pattern: finds the pre-tokens of normalised text below U+0250; None: always the library."""
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread; others would each keep an arena
        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(pattern).findall if pattern else None

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens as normalised text, and how many special strings stood between them."""
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        out: list[str] = []
        for part in parts:
            if self.find and not _BEYOND.search(part):
                out += self.find(part.lower())
            else:
                norm = self.lib.normalizer.normalize_str(part) if self.lib.normalizer else part
                out += [norm[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(norm)]
        return out, len(parts) - 1

    def n_pieces(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch(tokens, add_special_tokens=False)]


#: Pre-tokens of normalised text for the word-end BPE file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _pre_tokenizer(path: str, pattern: str | None) -> PreTokenizer:
    """One per worker process, which runs many tasks."""
    return PreTokenizer(path, pattern)


@lru_cache(maxsize=1)
def _single_entries(pre: PreTokenizer) -> frozenset[str]:
    """ASCII words of the vocabulary that are one piece: a table of the file's size."""
    words = [w[:-4] for w in pre.lib.get_vocab() if w.endswith("</w>") and len(w) > 4 and w[:-4].isascii() and w[:-4].isalpha()]
    return frozenset(w for w, n in zip(words, pre.n_pieces(words), strict=True) if n == 1)


def _emit_with(path: str, pattern: str | None):
    """(doc_id, text) to messages: the chunk's header (token null) and one row per distinct pre-token."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, pre = TaskContext.get().partitionId(), _pre_tokenizer(path, pattern)
        single = _single_entries(pre)
        for number, batch in enumerate(batches(rows, CHUNK)):
            known = np.zeros(batch.num_rows, dtype=np.int64)
            tokens, times, pairs = [], [], np.zeros(batch.num_rows, dtype=np.int64)
            parts: list[pa.Array] = []
            for d in range(batch.num_rows):
                found, known[d] = pre.pre_tokens(batch.column(1)[d].as_py() or "")
                counted = Counter(found)
                for token in single.intersection(counted):
                    known[d] += counted.pop(token)
                tokens += counted.keys()
                times += counted.values()
                pairs[d] = len(counted)
                if len(tokens) > 50_000:
                    parts.append(pa.array(tokens, pa.string()))
                    tokens = []
            parts.append(pa.array(tokens, pa.string()))
            tokens = []
            n_bytes = np.diff(string_parts(batch.column(1))[1])
            header = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(known)], ["doc_id", "n_bytes", "known"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, header.schema) as w:
                w.write_batch(header)
            yield _messages(pa.array([None], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), task, number)
            yield from _postings(pa.chunked_array(parts), np.repeat(np.arange(batch.num_rows), pairs), np.array(times, dtype=np.int64), task, number)
            pa.default_memory_pool().release_unused()

    return run


def _postings(tokens: pa.ChunkedArray, doc: np.ndarray, times: np.ndarray, task: int, number: int) -> Iterator[pa.RecordBatch]:
    """One message per distinct token: its (document, times) pairs as 16-bit numbers."""
    coded = tokens.combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy()
    while (large := np.flatnonzero(times > 65535)).size:  # a pair holds 16 bits; more pairs hold the rest
        code, doc, times = np.append(code, code[large]), np.append(doc, doc[large]), np.append(times, times[large] - 65535)
        times[large] = 65535
    order = np.argsort(code, kind="stable")
    pairs = np.empty((len(order), 2), dtype="<u2")
    pairs[:, 0], pairs[:, 1] = doc[order], times[order]
    ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary))) * 4
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    bodies = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])
    for i in range(0, len(bodies), 20_000):
        yield _messages(coded.dictionary.slice(i, 20_000), bodies.slice(i, 20_000), task, number)


def _messages(tokens: pa.Array, bodies: pa.Array, task: int, number: int) -> pa.RecordBatch:
    n = len(tokens)
    return pa.RecordBatch.from_arrays([tokens, pa.array(np.full(n, task, dtype=np.int32)), pa.array(np.full(n, number, dtype=np.int32)), bodies], ["token", "task", "batch", "body"])


def _sums(task: list[int], number: list[int], header: bool, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(number, pa.int32()), pa.array([header] * len(task)), pa.array(bodies, pa.binary())], ["task", "batch", "header", "body"])


def _count_with(path: str, pattern: str | None):
    """Messages sorted by pre-token to (task, batch, body): sums per chunk, and the headers as they are."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = _pre_tokenizer(path, pattern)
        sums: dict[tuple[int, int], np.ndarray] = {}
        last, last_n = None, 0

        def flush() -> pa.RecordBatch:
            out = _sums([k[0] for k in sums], [k[1] for k in sums], False, [v.astype("<i8").tobytes() for v in sums.values()])
            sums.clear()
            return out

        for batch in rows:
            heads = batch.filter(batch.column(0).is_null())
            if heads.num_rows:
                yield _sums(heads.column(1).to_pylist(), heads.column(2).to_pylist(), True, heads.column(3).to_pylist())
                batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            # Sorted rows: only the first token can have been counted with the batch before.
            new = [t for t in distinct if t != last]
            n_of = dict(zip(new, pre.n_pieces(new), strict=True)) | ({last: last_n} if last in distinct else {})
            pieces = np.array([n_of[t] for t in distinct])[coded.indices.to_numpy()]
            last, last_n = batch.column(0)[batch.num_rows - 1].as_py(), int(pieces[-1])
            data, offsets = string_parts(batch.column(3))
            pairs, per_row = data.view("<u2").reshape(-1, 2), np.diff(offsets) // 4
            chunk, at = np.unique(np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()]), axis=1, return_inverse=True)
            place = np.repeat(at.reshape(-1) * CHUNK, per_row) + pairs[:, 0]
            total = np.bincount(place, weights=pairs[:, 1] * np.repeat(pieces, per_row), minlength=chunk.shape[1] * CHUNK).reshape(-1, CHUNK)
            for k, row in zip(map(tuple, chunk.T.tolist()), total, strict=True):
                sums[k] = sums[k] + row if k in sums else row
            if len(sums) > 1024:
                yield flush()
        if sums:
            yield flush()

    return run


def _sum_with(schema: pa.Schema):
    """Rows sorted by chunk, the header first, to one row per document."""

    def finish(header: bytes, sums: np.ndarray) -> pa.RecordBatch:
        with pa.ipc.open_stream(header) as r:
            rows = r.read_next_batch()
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(rows.column(2).to_numpy() + sums[: rows.num_rows])], ["doc_id", "n_bytes", "n_tokens"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, sums = None, np.zeros(0, dtype=np.int64)
        for batch in rows:
            for is_header, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if is_header:
                    if header is not None:
                        yield finish(header, sums)
                    header, sums = body, np.zeros(CHUNK, dtype=np.int64)
                else:
                    sums += np.frombuffer(body, dtype="<i8")
        if header is not None:
            yield finish(header, sums)

    return run


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    messages = rows.mapInArrow(_emit_with(tokenizer, pattern), MESSAGE)
    key = F.when(F.col("token").isNull(), F.xxhash64("task", "batch")).otherwise(F.xxhash64("token"))
    met = messages.repartition(key).sortWithinPartitions("token")
    sums = met.mapInArrow(_count_with(tokenizer, pattern), "task int, batch int, header boolean, body binary")
    by_chunk = sums.repartition("task", "batch").sortWithinPartitions("task", "batch", F.desc("header"))
    return by_chunk.mapInArrow(_sum_with(None), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
