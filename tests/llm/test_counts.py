"""Token counts, packing, language ID, language model."""

from __future__ import annotations

import math
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import language_id, lm_score, packing, queries, token_counts
from quillspark.llm import _arrays as A

from conftest_docs import documents, prose

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@given(st.text(), st.text())
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(a, b):
    got = [w for _, _, x in A.column_words(pa.array([a, None, b]), A.NOT_SPACE, 4) for w in [x.word(i) for i in range(len(x.start))]]
    import regex

    want = [w.encode() for t in (a, b) for w in regex.findall(r"[^\x20\x09-\x0D]+", t)]
    assert got == want
    words = A.split_words(*A.string_parts(pa.array([a, b])), A.NOT_SPACE)
    h = words.hashes()
    assert len(set(h.tolist())) == len(set(want))


def test_many_short_texts_stay_small():
    """10,000 titles of letters that hardly repeat: tables of counts are cut by documents."""
    r = np.random.default_rng(5)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9FA0, 16))) for _ in range(10_000)]
    resource_test = f"""
import resource, sys
sys.path.insert(0, {str(Path(language_id.__file__).parents[2])!r})
import numpy as np, pyarrow as pa
from quillspark.llm import language_id
r = np.random.default_rng(5)
texts = ["".join(map(chr, r.integers(0x4E00, 0x9FA0, 16))) for _ in range(10_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
language_id.Profiler().bundles(pa.array(texts))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", resource_test], capture_output=True, text=True, check=True).stdout)
    assert grown < 500
    some = pa.array(texts[:40])
    whole, _ = language_id.Profiler().bundles(some)
    alone = np.concatenate([language_id.Profiler().bundles(some.slice(k, 1))[0] for k in range(40)])
    assert np.allclose(whole, alone)


def brute_language(train, texts, dim=language_id.DIM, n=language_id.N):
    """Predictions from n-gram vectors made one by one."""
    vector = lambda p: language_id.letter_vectors(np.array([p]), dim)[0].astype(float)

    def bundle(text):
        letters = [c.lower()[0] if c.isalpha() else " " for c in text or ""]
        framed = re.sub(" +", " ", " " + "".join(letters) + " ")
        out = np.zeros(dim)
        for i in range(len(framed) - n + 1):
            gram = np.ones(dim)
            for k in range(n):
                gram *= np.roll(vector(ord(framed[i + k])), n - 1 - k)
            out += gram
        return out, any(c.isalpha() for c in text or "")

    unit = lambda v: v / max(1e-12, np.linalg.norm(v))
    langs = sorted({lang for lang, t in train if lang is not None and t is not None})
    protos = [unit(sum(bundle(t)[0] for own, t in train if own == lang and t is not None)) for lang in langs]
    mean = np.mean(protos, axis=0) if len(protos) > 1 else np.zeros(dim)
    protos, out = [unit(p - mean) for p in protos], []
    for t in texts:
        made, has = bundle(t)
        cosine = [float(unit(unit(made) - mean) @ p) for p in protos]
        out.append((langs[int(np.argmax(cosine))], min(1.0, max(0.0, max(cosine)))) if has and langs else ("und", 0.0))
    return out


def test_predictions_equal_brute_force(spark):
    words = {"aa": "banana papaya kawa tasa mala".split(), "bb": "sterk worpl grunt blitz".split(), "cc": "ñandú über çalış Éva".split()}
    r = np.random.default_rng(8)
    say = lambda lang, n: " ".join(r.choice(words[lang], n))
    train = [(lang, say(lang, 12)) for lang in words for _ in range(4)] + [(None, "ignored words"), ("aa", None)]
    texts = [say(lang, k) for lang in words for k in (1, 3, 9)] + [None, "", "12 - !", "Ünlü 7 banana", say("bb", 40)]
    protos = language_id.prototypes(spark.createDataFrame(train, "lang string, text string"))
    rows = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), protos).collect()
    got, want = {r.doc_id: (r.lang_pred, r.score) for r in rows}, brute_language(train, texts)
    assert [got[k][0] for k in range(len(texts))] == [lang for lang, _ in want]
    assert np.allclose([got[k][1] for k in range(len(texts))], [s for _, s in want], atol=1e-4)


def test_token_counts(docs, empty):
    lib = Tokenizer.from_file(WORD_FILE)
    want = Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in documents())
    got = token_counts.count_tokens(docs, WORD_FILE, token_counts.WORD_PATTERN).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(empty, WORD_FILE, token_counts.WORD_PATTERN).count() == 0


@given(st.text(alphabet=st.characters(max_codepoint=0x260, exclude_categories=["Cs"])))
@settings(max_examples=150, deadline=None)
def test_fast_pre_tokens_equal_the_library(text):
    pre = token_counts._pre_tokenizer(WORD_FILE, token_counts.WORD_PATTERN)
    found, special = pre.pre_tokens(text)
    assert special + sum(pre.n_pieces(found)) == len(pre.lib.encode(text, add_special_tokens=False).ids)


def test_every_fast_character():
    pre = token_counts._pre_tokenizer(WORD_FILE, token_counts.WORD_PATTERN)
    for point in range(0x250):
        text = f"a{chr(point)}b {chr(point)}{chr(point)} 1{chr(point)}"
        found, special = pre.pre_tokens(text)
        assert special + sum(pre.n_pieces(found)) == len(pre.lib.encode(text, add_special_tokens=False).ids), hex(point)


def test_packing(docs, empty):
    lib = Tokenizer.from_file(BYTE_FILE)
    ids = defaultdict(list)
    for r in documents():
        ids[r[0]].append(np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, packing.END], dtype="<u4"))
    rows = packing.pack(docs, **queries.packing_args()).collect()
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty, **queries.packing_args()).count() == 0


@given(st.lists(st.integers(0, 400), min_size=65, max_size=65))
@settings(max_examples=25, deadline=None)
def test_plan_places_every_piece_once(counts):
    c = np.array(counts)
    c[0] = c[64] = 0
    slots, n = packing.plan(c, 64)
    for length in range(1, 64):
        spans = sorted((s.low, s.high) for s in slots if s.length == length)
        assert sum(b - a for a, b in spans) == c[length] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    if c.sum() > 2000:
        assert (c * np.arange(65)).sum() / (64 * n) > 0.9


def test_nnls_against_known():
    a, x = np.array([[1.0, 0, 1], [0, 2, 1], [1, 1, 0], [2, 0, 1]]), np.array([1.0, 2.0, 0.0])
    assert np.allclose(packing.nnls(a, a @ x, 3000), x, atol=1e-3)


def test_language_id(spark, empty):
    en, fr = "the of and that with this from have are was", "le la les des une pour dans avec que est"
    rows = [(i, " ".join(np.random.default_rng(i).choice((en if i % 2 else fr).split(), 30)), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(60, None, "en"), (61, "123 ... !", "fr"), (62, "the of that", None), (None, "le la les", None), (64, "the of and " * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    protos = language_id.prototypes(df.filter("doc_id < 40"))
    got = {r.doc_id: r for r in language_id.predict(df, protos).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(40, 60)) >= 19
    assert got[60].lang_pred == got[61].lang_pred == "und" and got[60].score == got[61].score == 0
    assert got[62].lang_pred == got[64].lang_pred == "en" and got[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.predict(df.limit(3), language_id.prototypes(empty)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.predict(empty, protos).count() == 0
    assert language_id.keep_language(df, protos).count() == len(rows) - 2


def test_profile_is_the_sum_of_bound_vectors():
    p = language_id.Profiler(256)
    made, has = p.bundles(pa.array(["Ab", "", None]))
    v = {c: language_id.letter_vectors(np.array([ord(c)]), 256)[0] for c in " ab"}
    bind = lambda x, y, z: np.roll(v[x], 2) * np.roll(v[y], 1) * v[z]
    assert np.allclose(made[0], bind(" ", "a", "b") + bind("a", "b", " "))
    assert has.tolist() == [True, False, False]


def reference_scores(train: list[str], texts: list[str], least: int) -> list[tuple[float, float, int]]:
    """The same model with dictionaries."""
    low = lambda t: [w.encode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()] + [None]
    uni, tri, context = Counter(), Counter(), Counter()
    for t in train:
        tokens = low(t)
        uni.update(tokens)
        tri.update(zip(["<s>", "<s>", *tokens], ["<s>", *tokens], tokens, strict=False))
    for (a, b, _), n in tri.items():
        context[a, b] += n
    bi = Counter((b, c) for _, b, c in tri)  # distinct words before the pair
    one = Counter(c for _, c in bi)
    after, heads = defaultdict(lambda: [0, 0, 0]), Counter()
    for (b, _), n in bi.items():
        after[b][min(n, 3) - 1] += 1
        heads[b] += n
    of = lambda counts: lm_score.discounts(np.array([sum(c == k for c in counts) for k in (1, 2, 3, 4)]))
    d3, d2, d1 = of(tri.values()), of(bi.values()), of(one.values())
    less = lambda n, d: n - d[min(n, 3) - 1] if n else 0.0
    kept = Counter()
    for (a, b, _), n in tri.items():
        if n >= least:
            kept[a, b] += less(n, d3)
    total, v, pairs = sum(uni.values()), len(uni), len(bi)
    rest = sum(d1[min(n, 3) - 1] for n in one.values()) / pairs
    out = []
    for t in texts:
        a, b, score, base, known = "<s>", "<s>", 0.0, 0.0, 0
        for w in low(t):
            p = less(one[w], d1) / pairs + rest / (v + 1)
            if heads[b]:
                p = less(bi[b, w], d2) / heads[b] + sum(d * k for d, k in zip(d2, after[b], strict=True)) / heads[b] * p
            if context[a, b]:
                n = tri[a, b, w] if tri[a, b, w] >= least else 0
                p = less(n, d3) / context[a, b] + (1 - kept[a, b] / context[a, b]) * p
            score += math.log10(p)
            base += math.log10((uni[w] + 0.1) / (total + 0.1 * (v + 1)))
            known += uni[w] > 0
            a, b = b, w
        out.append((score, base, known))
    return out


def test_language_model(spark, docs, empty):
    texts = [prose("t", 300), prose("t", 40), prose("u", 60), "", None, prose("t", 300), "Unknown words ONLY"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    train = [texts[k] or "" for k in (0, 2, 4, 5)]
    for shards, least in ((3, 2), (40, 2), (2, 1)):
        model = lm_score.train(df.filter("doc_id IN (0, 2, 4, 5)"), shards=shards, least=least)
        got = sorted(lm_score.score(df, model).collect())
        for r, (score, base, known) in zip(got, reference_scores(train, [t or "" for t in texts], least), strict=True):
            assert r.score == pytest.approx(score) and r.base_score == pytest.approx(base) and r.n_known == known
            assert r.train_tokens == sum(len(t.split()) + 1 for t in train)
    nothing = lm_score.train(empty)
    assert all(r.n_known == 0 and r.score == 0 for r in lm_score.score(df, nothing).collect())
    assert lm_score.score(docs, model).count() == len(documents()) and lm_score.score(empty, model).count() == 0


def test_every_trigram_is_scored(spark):
    """Trigrams that occur once keep their own probability unless a caller leaves them out."""
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in np.minimum(r.geometric(0.08, n), 60)) for n in (1, 2, 3, 5000, 4000, 40, 41)] + ["the the of " * 300, "a passage that is here only once", "once only here is that passage a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    train = [*texts[:5], *texts[7:9]]
    got = lm_score.score(df, lm_score.train(df.filter("doc_id < 5 OR doc_id IN (7, 8)"))).orderBy("doc_id").collect()
    want, pruned = reference_scores(train, texts, 1), reference_scores(train, texts, 2)
    assert [x.score for x in got] == pytest.approx([x[0] for x in want])
    assert [x.n_known for x in got] == [x[2] for x in want]
    assert got[8].score > pruned[8][0] + 0.5 and got[8].score > got[9].score + 5


@pytest.mark.parametrize("least", [1, 2])
def test_probabilities_sum_to_one(spark, least):
    df = spark.createDataFrame([(1, "a b a c a b d b a"), (2, "b b c a")], "doc_id bigint, text string")
    model = lm_score.train(df, shards=2, least=least)
    total = {}
    for head in ("", "a ", "b ", "zz ", "a b ", "b a ", "zz a ", "c zz ", "d a "):
        # One word after the head, and the end token or an unknown word in its place.
        probe = [f"{head}{w}" for w in ("a", "b", "c", "d", "unknown")] + [head.strip()]
        words = A.split_words(*A.string_parts(pa.array(probe)), A.NOT_SPACE)
        hashes, bounds = lm_score._tokens(words)
        logs, _, _ = model.log10(hashes, bounds)
        total[head] = sum(10 ** logs[b + len(head.split())] for b in bounds[:-1])
    assert all(v == pytest.approx(1) for v in total.values())


def test_pairings_and_counts():
    """Keys of pairs are a bijection in shard order; packed counts come back, also beyond 32 bits."""
    r = np.random.default_rng(2)
    for n_ids in (3, 1 << 19, (1 << 26) + 5, (1 << 32) - 2):
        pairing = lm_score.Pairing(n_ids)
        a, b = r.integers(0, n_ids + 1, 500), r.integers(0, n_ids + 1, 500)
        keys = np.sort(pairing.key(a, b))
        assert sorted(zip(*(x.tolist() for x in pairing.ids(keys)), strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
        shards = pairing.shard(keys, 7)
        assert (np.diff(shards.astype(int)) >= 0).all() and all(k >= pairing.first(int(s), 7) for k, s in zip(keys.tolist(), shards, strict=True))
    t = lm_score.Triples(r.integers(0, 50, 300).astype(np.uint64), r.integers(0, 4, 300), r.integers(1, 1 << 40, 300))
    keys, heads, counts = lm_score.Triples.unpacked(t.packed(0, len(t)))
    assert (keys == t.keys).all() and (heads == t.heads).all() and (counts == t.counts).all()
    small = lm_score._small(t.counts)
    assert (lm_score._large(*small, np.arange(len(t))) == t.counts).all()


def test_narrow_numbers():
    r = np.random.default_rng(3)
    for bits in (1, 8, 9, 24, 40, 63):
        x = r.integers(0, 1 << bits, 200)
        raw, at = lm_score._narrow(x), r.integers(0, 200, 50)
        assert (lm_score._widened(raw, 200, at) == x[at]).all() and (lm_score._widened(raw, 200, slice(None)) == x).all()
