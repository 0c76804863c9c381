"""Language identification by hyperdimensional letter profiles.

Each letter owns a random +-1 vector drawn from its code point.  A letter n-gram is
the product of its letters' vectors, each permuted (rotated) by its place; a text is
the sum (bundle) of its n-grams' vectors, and a language prototype the sum over its
training texts.  A text gets the language whose prototype has the largest
cosine.  Letters are lower-cased, runs of anything else are one space, and
texts are framed by spaces.

Training counts n-grams by language in Spark; what reaches the driver is one
prototype of ``dim`` numbers per language (at most ``MAX_LANGUAGES``, checked).  A
common part shared by all prototypes is removed before they are compared, so that the
cosine depends on what tells the languages apart.

Defined cases: null text, or text without a letter, is ``und`` with score 0; rows
whose language is null do not train; ties go to the language that sorts first; if
nothing trains, all are ``und``; repeated rows are rows; very long texts are summed by
pieces; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrays import mix, slices, string_parts, trimmed

DIM, N = 1024, 3
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_PIECE = 1 << 19
#: Counts in one dense table, and distinct n-grams of a language that a task holds before it bundles them.
_CELLS, _GRAMS = 1 << 22, 1 << 16


def _coded(gram: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and each gram's place among them."""
    if codes > 1 << 24 or len(gram) * 16 < codes:
        return np.unique(gram, return_inverse=True)
    used = np.flatnonzero(np.bincount(gram, minlength=1)) if len(gram) else np.zeros(0, dtype=np.int64)
    index = np.zeros(int(used[-1]) + 1 if len(used) else 1, dtype=np.int64)
    index[used] = np.arange(len(used))
    return used, index[gram] if len(gram) else gram


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Random +-1 rows, one per code point, the same on every machine."""
    cells = mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim // 64, dtype=np.uint64)[None] + np.uint64(1))
    bits = np.unpackbits(np.ascontiguousarray(cells).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


class Profiler:
    """Bundles of n-gram vectors of texts."""

    def __init__(self, dim: int = DIM, n: int = N) -> None:
        self.dim, self.n = dim, n
        self.folded: dict[int, int] = {}

    def _fold(self, point: int) -> int:
        """The letter's lower-case code point, or a space."""
        if point not in self.folded:
            c = chr(point)
            low = c.lower()
            self.folded[point] = (ord(low[0]) if c.isalpha() else 32)
        return self.folded[point]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
        """(blocks, whether each document has a letter).

        A block: documents from, to, counts[document, gram], grams' code points[gram, n]; its table
        has ``_CELLS`` numbers at most, or those of one document.
        """
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        lead = (data & 0xC0) != 0x80  # bytes that begin a code point
        at = np.concatenate([[0], np.cumsum(lead)])[offsets]
        present = np.flatnonzero(np.bincount(points, minlength=1)) if len(points) else np.zeros(0, dtype=np.int64)
        table = np.zeros(int(present[-1]) + 1 if len(present) else 1, dtype=np.int64)
        folded = np.array([self._fold(int(p)) for p in present], dtype=np.int64)
        letters, code = np.unique(np.concatenate([[32], folded]), return_inverse=True)
        space = int(code[0])
        table[present] = code[1:]
        n_docs, a = len(offsets) - 1, len(letters)
        doc = np.repeat(np.arange(n_docs), np.diff(at))
        sym = table[points] if len(points) else np.zeros(0, dtype=np.int64)
        # A space before every text, one after it, and none after another.
        ins = at[:-1] + np.arange(n_docs) * 2
        full, owner = np.full(len(sym) + 2 * n_docs, space), np.repeat(np.arange(n_docs), np.diff(at) + 2)
        mask = np.ones(len(full), dtype=bool)
        mask[ins] = mask[at[1:] + np.arange(n_docs) * 2 + 1] = False
        full[mask] = sym
        has = np.bincount(doc, weights=sym != space, minlength=n_docs) > 0
        keep = np.ones(len(full), dtype=bool)
        keep[1:] = (full[1:] != space) | (full[:-1] != space) | (owner[1:] != owner[:-1])
        full, owner = full[keep], owner[keep]
        m = max(0, len(full) - self.n + 1)
        gram = np.zeros(m, dtype=np.int64)
        for k in range(self.n):
            gram = gram * a + full[k : k + m]
        inside = owner[:m] == owner[self.n - 1 :][:m] if m else np.zeros(0, dtype=bool)
        gram, owner = gram[inside], owner[:m][inside]
        blocks, at = [], np.searchsorted(owner, np.arange(n_docs + 1))
        for lo, hi in self._runs(gram, at, a**self.n):
            part = slice(at[lo], at[hi])
            used, column = _coded(gram[part], a**self.n)
            table2 = np.bincount((owner[part] - lo) * max(1, len(used)) + column, minlength=(hi - lo) * max(1, len(used))).reshape(hi - lo, -1).astype(np.float32)
            places = np.stack([letters[used // a ** (self.n - 1 - k) % a] for k in range(self.n)], axis=1) if len(used) else np.zeros((0, self.n), dtype=np.int64)
            blocks.append((lo, hi, table2[:, : len(used)], places))
        return blocks, has

    def _runs(self, gram: np.ndarray, at: np.ndarray, codes: int) -> Iterator[tuple[int, int]]:
        """Runs of documents whose number times their distinct grams is ``_CELLS`` at most."""
        stack = [(0, len(at) - 1)] if len(at) > 1 else []
        while stack:
            lo, hi = stack.pop()
            n = int(at[hi] - at[lo])
            if hi - lo > 1 and n * (hi - lo) > _CELLS and len(_coded(gram[at[lo] : at[hi]], codes)[0]) * (hi - lo) > _CELLS:
                middle = (lo + hi) // 2
                stack += [(middle, hi), (lo, middle)]
            else:
                yield lo, hi

    def gram_vectors(self, places: np.ndarray) -> np.ndarray:
        """Bound vectors: the product over places of the letter's vector rotated by the place."""
        out = np.ones((len(places), self.dim), dtype=np.float32)
        letters, code = np.unique(places, return_inverse=True)
        base, code = letter_vectors(letters, self.dim), code.reshape(places.shape)
        for k in range(self.n):
            out *= np.roll(base, self.n - 1 - k, axis=1)[code[:, k]]
        return out

    def bundles(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One bundle per text, and whether it has a letter."""
        data, offsets = string_parts(column)
        out, has = np.zeros((len(column), self.dim), dtype=np.float32), np.zeros(len(column), dtype=bool)
        for a, b in slices(offsets, _PIECE):
            for part, bounds in _pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                blocks, some = self.counts(part, bounds)
                for lo, hi, counts, places in blocks:
                    for g in range(0, len(places), 8192):
                        out[a + lo : a + hi] += counts[:, g : g + 8192] @ self.gram_vectors(places[g : g + 8192])
                has[a:b] |= some
        return out, has


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The slice itself, or one very long document in pieces that end at a space."""
    if len(offsets) > 2 or len(data) <= most:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        if end < len(data):
            gaps = np.flatnonzero(data[at:end] == 32)
            end = at + int(gaps[-1]) if len(gaps) and gaps[-1] else end
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        yield data[at:end], np.array([0, end - at])
        at = end


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, n: int = N) -> dict[str, np.ndarray]:
    """Bundle of all training rows by language; a sum of ``dim`` numbers for each reaches the driver."""

    @trimmed
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of n-grams by language, bound and bundled once per task."""
        profiler, grams = Profiler(dim, n), {}

        def bundled(lang: str, total: dict) -> Iterator[pa.RecordBatch]:
            bundle, keys, values = np.zeros(dim), list(total), np.array(list(total.values()), dtype=np.float64)
            for g in range(0, len(keys), 8192):
                bundle += values[g : g + 8192] @ profiler.gram_vectors(np.array(keys[g : g + 8192], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim, dtype=np.int32)), pa.array(bundle)], ["lang", "i", "v"])

        for batch in rows:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            data, offsets = string_parts(batch.column(1))
            for a, b in slices(offsets, _PIECE):
                for part, bounds in _pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    for lo, hi, counts, places in profiler.counts(part, bounds)[0]:
                        rows_of, own = [tuple(p) for p in places.tolist()], langs[a + lo : a + hi]
                        for lang in dict.fromkeys(own):
                            total = grams.setdefault(lang, {})
                            for gram, c in zip(rows_of, counts[own == lang].sum(0, dtype=np.float64).tolist(), strict=True):
                                if c:
                                    total[gram] = total.get(gram, 0) + c
                            if len(total) > _GRAMS:
                                yield from bundled(lang, grams.pop(lang))
        for lang, total in grams.items():
            yield from bundled(lang, total)

    train = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sums = train.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    packed = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))
    rows = packed.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: np.array(r.v) for r in sorted(rows, key=lambda r: r.lang)}


class Classifier:
    def __init__(self, protos: dict[str, np.ndarray], dim: int = DIM, n: int = N) -> None:
        self.langs, self.profiler = list(protos), Profiler(dim, n)
        unit = np.array([p / max(1e-12, np.linalg.norm(p)) for p in protos.values()]).reshape(len(protos), dim)
        self.mean = unit.mean(0) if len(protos) > 1 else np.zeros(dim)
        centred = unit - self.mean
        self.unit = (centred / np.maximum(1e-12, np.linalg.norm(centred, axis=1, keepdims=True))).astype(np.float32)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        made, has = self.profiler.bundles(column)
        if not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        made /= np.maximum(1e-12, np.linalg.norm(made, axis=1, keepdims=True))
        made -= self.mean
        made /= np.maximum(1e-12, np.linalg.norm(made, axis=1, keepdims=True))
        cosine = made @ self.unit.T
        best = cosine.argmax(1)
        score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)], score.astype(np.float64)


def predict(docs: DataFrame, protos: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, n: int = N) -> DataFrame:
    """doc_id, lang_pred, score for each document."""
    model = docs.sparkSession.sparkContext.broadcast(protos)

    @trimmed
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value, dim, n)
        for batch in rows:
            langs, score = classifier.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_language(docs: DataFrame, protos: dict[str, np.ndarray], languages: set[str] | None = None, least: float = 0.0, text_col: str = "text", dim: int = DIM, n: int = N) -> DataFrame:
    """The rows, unchanged, whose predicted language is wanted (None: any but ``und``) with at least this score."""
    model, k = docs.sparkSession.sparkContext.broadcast(protos), docs.columns.index(text_col)

    @trimmed
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value, dim, n)
        for batch in rows:
            langs, score = classifier.predict(batch.column(k))
            yield batch.filter(pa.array([x != UNKNOWN and (languages is None or x in languages) and s >= least for x, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
