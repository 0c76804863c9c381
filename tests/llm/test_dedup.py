"""Near duplicates and repeated passages against brute force; the pipeline's stages."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import minhash_dedup, suffix_dedup
from quillspark.llm._arrays import NOT_SPACE, split_words, string_parts, window_hashes

from conftest_docs import documents, prose


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t: str | None) -> Counter:
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def probability_jaccard(a: Counter, b: Counter) -> Fraction:
    return sum((1 / sum(max(Fraction(a[j], a[i]), Fraction(b[j], b[i])) for j in a | b) for i in a.keys() & b.keys()), Fraction(0))


def similar(a: Counter, b: Counter) -> bool:
    """Probability Jaccard similarity of 0.8 or more; of plain sets it is the Jaccard similarity."""
    if max(a.values(), default=1) == max(b.values(), default=1) == 1:
        return len(a.keys() & b.keys()) * 10 >= len(a.keys() | b.keys()) * 8 > 0
    return bool(a & b) and probability_jaccard(a, b) >= Fraction(4, 5)


def brute_classes(texts: list[str]) -> list[int]:
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] == texts[b] or similar(sets[a], sets[b]):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return [find(k) for k in range(len(texts))]


def near_copies(seed: int, n: int, share: float) -> list[str]:
    """Copies of one text with words changed at random: a group in which only some pairs are links."""
    r, base = np.random.default_rng(seed), prose(f"group{seed}", 150).split()
    out = []
    for _ in range(n):
        rate = r.uniform(0, share)
        out.append(" ".join(prose(f"{seed}/{r.integers(1 << 40)}", 1) if r.random() < rate else w for w in base))
    return out


def test_classes(spark, docs, empty):
    texts = [r[1] or "" for r in documents() if r[0] is not None]
    texts += near_copies(1, 60, 0.06) + near_copies(2, 25, 0.01) + [prose(f"single{k}", 80) for k in range(30)] + ["a b c", "A b c", "a b d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in minhash_dedup.report(df).collect()}
    assert [got[k].class_id for k in range(len(texts))] == brute_classes(texts)
    assert sum(r.kept for r in got.values()) == len(set(brute_classes(texts)))
    assert minhash_dedup.report(docs).count() == len(documents())
    assert minhash_dedup.report(empty).count() == 0 and minhash_dedup.keep_one(empty).count() == 0


def test_keep_one(docs):
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(brute_classes([r[1] or "" for r in documents()])))
    assert {r.doc_id for r in rows} >= {0, 6, 7, 8, 9, 10, 13} and not {1, 2} & {r.doc_id for r in rows}


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(3)
    ids = r.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = r.integers(1, 6, 60), r.integers(0, 6, 60)
    keep = b > 0
    doc = np.concatenate([np.zeros(60, int), np.ones(keep.sum(), int)])
    sig = minhash_dedup.prob_minhash(doc, np.concatenate([ids, ids[keep]]), np.concatenate([a, b[keep]]), 2, 4096)
    want = sum(1 / sum(max(x / a[i], y / b[i]) for x, y in zip(a, b, strict=True)) for i in range(60) if b[i])
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_components(spark, tmp_path):
    chain = [(bytes([k]), bytes([k + 1])) for k in range(1, 40)] + [(b"x", b"y"), (b"y", b"z")]
    got = {bytes(r.node): bytes(r.root) for r in minhash_dedup.connected(spark.createDataFrame(chain, "a binary, b binary"), f"file://{tmp_path}").collect()}
    assert {got[bytes([k])] for k in range(1, 41)} == {b"\x01"} and {got[x] for x in (b"x", b"y", b"z")} == {b"x"}


def test_copies_that_repeat_a_passage(spark):
    """Repeated parts weigh: bands, sketch and verification ask for one similarity, that of weighted shingles."""
    texts = []
    for k, (n, part, times) in enumerate([(104, 34, 8), (204, 44, 16), (104, 20, 1), (104, 8, 2), (60, 12, 1)] * 6):
        text = [f"w{k}x{i}" for i in range(n)]
        again = text + text[:part] * times
        texts += [" ".join(text), " ".join(again), " ".join([*again[:50], f"w{k}", *again[51:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in minhash_dedup.report(df).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(texts) / 3 < len(set(want)) < len(texts)  # some of them are classes of their own


def test_probability_jaccard():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = (Counter({i: int(r.integers(1, 5)) for i in range(20) if r.random() < 0.7}) for _ in range(2))
        both = sorted(a.keys() & b.keys())
        got = minhash_dedup.probability_jaccard(np.array([a[i] for i in both]), np.array([b[i] for i in both]), sum(a.values()), sum(b.values()))
        assert got == pytest.approx(float(probability_jaccard(a, b)))


def test_large_group_near_the_threshold(spark, monkeypatch):
    """Hundreds of texts with most pairs a little above or below it, met in several blocks and parts."""
    monkeypatch.setattr(minhash_dedup, "DEALT", 64)
    texts = near_copies(11, 350, 0.05) + near_copies(12, 250, 0.08)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in minhash_dedup.report(df).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want and 10 < len(set(want)) < 590


def brute_passages(texts: list[str]) -> dict[int, set[int]]:
    """Per document: words in 50-word windows that occur at two places of distinct texts or of one."""
    places, first, copies = defaultdict(set), {}, Counter(texts)
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    for i in first.values():
        w = words(texts[i])
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add((i, k))
    out = {}
    for i, t in enumerate(texts):
        w = words(t)
        hit = set(range(len(w))) if copies[t] > 1 and len(w) >= 50 else {j for k in range(len(w) - 49) if len(places[tuple(w[k : k + 50])]) > 1 for j in range(k, k + 50)}
        if hit:
            out[i] = hit
    return out


def test_passages(spark, docs, empty):
    p = [prose(f"p{k}", n) for k, n in enumerate((49, 50, 51, 80, 300))]
    texts = [r[1] or "" for r in documents() if r[0] is not None]
    texts += [f"{prose(f'l{k}', 30 + k)} {x} {prose(f'r{k}', 40)}" for k, x in enumerate(p * 4)] + [p[3] + " mid " + p[3]] + near_copies(5, 12, 0.05)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    want = brute_passages(texts)
    rows = suffix_dedup.report(df).collect()
    got = {r.doc_id: {j for s in r.spans for j in range(s.start, s.end)} for r in rows}
    assert got == want
    left = defaultdict(int)
    gone = {r.doc_id: {j for s in r.removable for j in range(s.start, s.end)} for r in rows}
    for i, t in enumerate(texts):
        for j, w in enumerate(words(t)):
            left[w] += j not in gone.get(i, ())
    assert all(left.values())  # every word stays somewhere
    assert suffix_dedup.report(docs).count() > 0 and suffix_dedup.report(empty).count() == 0


def test_remove(spark, docs, empty):
    out = suffix_dedup.remove(docs, chars_col="n_chars")
    assert out.columns == docs.columns
    rows = out.collect()
    passage = prose("passage", 70)
    assert sum(passage in (r.text or "") for r in rows) == 1
    assert sum((r.text or "") == prose("base", 200) for r in rows) <= 1
    assert {3, 4, 5, 6} <= {r.doc_id for r in rows}
    assert all(r.n_chars in (None, len(r.text or "")) for r in rows)
    assert suffix_dedup.remove(empty).count() == 0


def test_minimisers():
    r = np.random.default_rng(0)
    values, first = r.integers(0, 50, 400).astype(np.uint64), np.array([0, 100, 103, 103, 400])
    want = set()
    for a, b in itertools.pairwise(first):
        for i in range(a, max(b - 19, a + (b > a))):
            want.add(i + int(np.argmin(values[i : min(b, i + 20)])))
    assert suffix_dedup.minimisers(values, first).tolist() == sorted(want)


def test_pipeline(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, prose("c", 120))], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for source in (docs, empty):
        df, counts = source, []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, f"file://{tmp_path}").write.mode("overwrite").parquet(f"file://{tmp_path}/{source is docs}-{k}")
            df = spark.read.parquet(f"file://{tmp_path}/{source is docs}-{k}")
            counts.append(df.count())
            if k < len(corpus_pipeline.STAGES) - 1:
                assert df.columns == docs.columns
        if source is docs:
            before = spark.read.parquet(f"file://{tmp_path}/True-3")
            ids = {r.doc_id for r in before.select("doc_id").collect()}
            assert 10 not in ids and 9 in ids and 3 not in ids and len(ids & {0, 1, 2}) == 1
            assert df.agg(F.countDistinct("doc_id")).first()[0] == len(ids - {None})
        else:
            assert counts == [0] * len(counts)


def test_one_copy_stays_beside_partial_ones(spark):
    """Passages that reach to both sides of their core, each with other texts that hold 40 of the 52 words."""
    passages = []
    for seed in itertools.count():
        passage = [f"p{seed}x{i}" for i in range(52)]
        split = split_words(*string_parts(pa.array([" ".join(passage)])), NOT_SPACE)
        cores, _ = window_hashes(split.hashes(), split.first, suffix_dedup.CORE)
        # The core in the middle is so small that every text starts a suffix there.
        if np.argmin(cores) in (10, 11) and cores.min() < np.uint64(1 << 64 - 8):
            passages.append(passage)
        if len(passages) == 6:
            break
    texts, n = [], 150
    for k, passage in enumerate(passages):
        for i in range(2 * n):
            own = passage if i < n else passage[6:46]
            # The surroundings differ from the first word on, so contexts sort in another order than texts.
            texts.append((k, i < n, " ".join([*(f"a{k}x{i}x{j}" for j in range(25)), *own, *(f"b{k}x{i}x{j}" for j in range(25))])))
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in suffix_dedup.report(df).collect()}
    assert sorted(rows) == [i for i, (_, full, _) in enumerate(texts) if full]
    assert all([tuple(s) for s in r.spans] == [(25, 77)] for r in rows.values())
    gone = Counter((texts[i][0], tuple(tuple(s) for s in r.removable)) for i, r in rows.items())
    assert gone == {(k, spans): m for k in range(6) for spans, m in (((), 1), (((25, 77),), n - 1))}
