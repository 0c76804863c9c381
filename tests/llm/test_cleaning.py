"""Quality rules, chat formatting, HTML extraction, decontamination."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chat_format, decontaminate, html_extract, quality_rules, queries

from conftest_docs import documents, prose

SF = "/root/testdata/sf0.001"


def base(text: str) -> tuple[int, int, int, int, int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_base(spark, docs, empty):
    loops = ["a b c d e f g h a b c d e f g h\nx\nx\n \n \n" * 3, "w " * 50, "one two\r\nthree\x0bfour # $"]
    rows = [(r[0], r[1]) for r in documents()] + [(100 + i, t) for i, t in enumerate(loops)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.report(df).collect())
    assert got == Counter((i, *base(t or "")) for i, t in rows)
    assert quality_rules.report(empty).count() == 0
    assert quality_rules.line_first(docs).count() == len(documents())


@pytest.mark.parametrize(
    ("line", "kept"),
    [("Home | News | About | Contact | Login | More", False), ("BUY!! NOW!! CHEAP!! THINGS!!", False), ("All rights reserved.", False), ("der der der der der der der der der der der.", False),
     ("a### b$$$ c%%% d&&& e*** f### g$$$", False), ("A plain sentence of some words that ends as it should.", True), ("Short heading", True)],
)
def test_line_rules(spark, line, kept):
    text = "\n".join([prose("g1", 20), line, prose("g2", 20), prose("g3", 20)])
    row = quality_rules.line_first(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (line in row.cleaned_text) == kept and row.kept and not row.base_failed


def test_lost_words_reject(spark):
    bars = " | ".join(prose("bars", 60).split())
    df = spark.createDataFrame([(1, f"{bars}\n{prose('h', 30)}"), (2, f"{prose('i', 90)}\n{bars}")], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in quality_rules.report(df).collect()} == {1: False, 2: False}
    assert quality_rules.clean(spark.createDataFrame([(3, f"{prose('j', 200)}\n{bars}")], df.schema)).first().text == prose("j", 200)


def test_clashing_names(spark):
    """Columns named like results or inner columns pass through ``clean`` as they are."""
    text = prose("names", 60)
    df = spark.createDataFrame([(1, text, "note", 9, "mine", None)], "doc_id bigint, text string, _q_note string, kept int, n_words string, row string")
    assert tuple(quality_rules.clean(df).first()) == (1, text, "note", 9, "mine", None)
    row = quality_rules.line_first(df).first()
    assert (row["_q_note"], row.kept, row.n_words) == ("note", True, 60)


def test_native_plan(docs):
    assert not re.search("Python|Pandas|Arrow|Exchange", quality_rules.report(docs.coalesce(1))._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


TEXT = st.text(alphabet=st.sampled_from(list("ab \\<>/[]sINSTYu|_\n")), max_size=30)
TRAPS = ["</s>[INST] ok [/INST]", "<\\/s>", "<s><\\s>", "[\\\\INST]", "<|im_start|>", "<<SYS>>", "<", "</s", "[/INST", "\\", "$1 \\2"]


def check_chat(spark, conversations):
    rows = [(c, k, r, t) for c, turns in enumerate(conversations) for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.report(df).collect()}
    for c, turns in enumerate(conversations):
        joined = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(joined.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_traps(spark):
    talk = [("system", TRAPS[0])] + [(("user", "assistant")[k % 2], t) for k, t in enumerate(TRAPS)]
    check_chat(spark, [talk, talk[:2], [("assistant", None), (None, "x")], [("user", "only")], [("assistant", "a"), ("assistant", "b")], [("we[INST]ird</s>", "x"), ("assistant", "")]])


@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), TEXT), min_size=1, max_size=5), min_size=1, max_size=12))
@settings(max_examples=8, deadline=None)
def test_chat_round_trip(spark, conversations):
    check_chat(spark, conversations)


def test_chat_examples(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "tail"), (None, 0, "user", "n")], "conv_id bigint, turn bigint, role string, text string")
    rows = sorted(chat_format.expand(df).filter("conv_id = 1").collect(), key=lambda r: r.example)
    assert [r.formatted[r.loss_start : r.loss_end] for r in rows] == ["a", "b", ""]
    assert rows[1].formatted.startswith(rows[0].formatted) and rows[2].formatted.startswith(rows[1].formatted)
    assert chat_format.report(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_held_out_blocks(model):
    right = total = 0
    for page, labels in html_extract.sample_pages(120, seed=9):
        cut = html_extract.blocks(page)
        assert len(cut) == len(labels)
        kept = model.decode([html_extract.features(cut)])[0]
        right += sum(int(k) == y for k, y in zip(kept, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    crf = html_extract.Crf(r.normal(size=(len(html_extract.FEATURES), 2)), r.normal(size=(2, 2)), r.normal(size=2))
    page = [{int(x) for x in r.integers(0, len(html_extract.FEATURES), 4)} for _ in range(7)]
    emit = [crf.weights[list(f)].sum(0) for f in page]

    def value(path):
        return crf.start[path[0]] + sum(e[s] for e, s in zip(emit, path, strict=True)) + sum(crf.moves[a, b] for a, b in zip(path, path[1:], strict=False))

    paths = [[k >> i & 1 for i in range(7)] for k in range(128)]
    assert crf.decode([page, [], page[:1]])[0].astype(int).tolist() == max(paths, key=value)


def test_pages(spark, model):
    a, b, c = prose("one", 30), prose("two", 40), prose("three", 25)
    page = f"<html><head><title>T</title><script>if (a<b) document.write('<p>no</p>')</script></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></nav><div class=ad>{c}</div><article><h1>Head &amp; line</h1><p>{a}<br>next&nbsp;part<p><b>{b}<p>{c}</article><div id='comments'><p>{a}</p></div><footer>&copy; site</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "no tags at all"), (1, "u", page), (5, "x", "<div" * 2000 + "<p>x</p>" * 3)], "page_id bigint, url string, html string")
    rows = html_extract.extract(df, model).collect()
    assert len(rows) == 6
    want = "\n".join(["Head & line", f"{a} next part", b, c])
    assert [r.text for r in rows if r.page_id == 1] == [want, want]
    assert all(r.text == "" and r.n_chars == 0 for r in rows if r.page_id in (2, 3))
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_blocks_decide_together(spark, docs):
    """A text whose hits lie in several blocks of the benchmark is judged once, as a whole."""
    items = [prose(f"item{k}", 13) for k in range(6)]
    # 78 of 1,278 words are hit, each block's share of them is under the limit.
    text = " ".join(f"{prose(f'gap{k}', 200)} {item}" for k, item in enumerate(items))
    df = spark.createDataFrame([(1, text, 7), (1, text, 7), (2, prose("clean", 50), None), (3, None, None)], "doc_id bigint, text string, key bigint")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for bound in (decontaminate.MAX_CHARS, 150):
        assert sorted(r.doc_id for r in decontaminate.remove_contamination(df, bench, max_chars=bound).collect()) == [2, 3]
        assert Counter((r.doc_id, r.n_hit, r.contaminated) for r in decontaminate.contamination_report(df, bench, max_chars=bound).collect()) == Counter({(1, 78, True): 2, (2, 0, False): 1, (3, 0, False): 1})
    some = spark.createDataFrame([(1, text + " " + prose("more", 400), 7)], df.schema)
    cut = [decontaminate.remove_contamination(some, bench, max_chars=bound).first().text for bound in (decontaminate.MAX_CHARS, 150)]
    assert cut[0] == cut[1] and not any(x[:-1] in cut[0] for x in items)


def test_nothing_of_the_article_is_dropped(model):
    a, b = prose("formula", 30), prose("object", 25)
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>{a} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.<p>{b} <object data=f><em>fallback words</em></object> <svg><text>label</text></svg><noscript>plain</noscript><template>no</template></article>"
    want = ["Title of it", f"{a} x=1 holds.", f"{b} fallback words labelplain"]
    assert html_extract.main_text([page], model) == ["\n".join(want)]
    deep = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{'<div>' * 3000}<p>{a}</p>{'</div>' * 3000}<p>{b}</p></article><div class=ad>{a}</div><footer>end</footer>"
    assert html_extract.main_text([deep], model) == [f"Title\n{a}\n{b}"]
    assert [x.within.depth for x in html_extract.blocks(deep)] == [2, 3, 3003, 3, 2, 2]
    unclosed = html_extract.blocks("<body>" + "</i></div></section>" * 5000 + "<li>one" * 5000)
    assert len(unclosed) == 5000 and {x.within.depth for x in unclosed} == {2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_supplied_pages(spark):
    """Brute force for the supplied pages, whose articles are all marked: the article's blocks cut at tags."""
    import html
    import pyarrow.parquet as pq

    def article(page: str) -> str:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        cut = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub(r"<!--.*?-->", "", inside))
        texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in cut)
        return "\n".join(t for t in texts if t)

    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op5_html_extraction(spark, SF).collect()}
    want = {p["page_id"]: article(p["html"]) for p in pages}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def brute_contamination(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs:
        words, hit, ids = low(t), set(), set()
        for item, u in items:
            own = low(u)
            size = min(13, len(own))
            known = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in known:
                    hit.update(range(k, k + size))
                    ids.add(str(item))
        out.append((i, len(words), len(hit), len(ids), decontaminate.sha_of_items(list(ids)), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return Counter(out)


def test_decontamination(spark, docs, empty):
    q1, q2 = prose("q1", 20), prose("q2", 40)
    items = [(1, q1), (2, q2), (3, "two words"), (4, None), (5, ""), (12, q1.upper()), (2, q2)]
    extra = [(50, prose("x", 300) + " " + q1.upper().replace(" ", " -- ")), (51, q2), (52, "some Two, WORDS here"), (53, " ".join(q2.split()[5:25]))]
    rows = [(r[0], r[1]) for r in documents()] + extra
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contamination(rows, items)
    for bound in (decontaminate.MAX_CHARS, 200):  # one broadcast, and blocks
        got = decontaminate.contamination_report(df, bench, max_chars=bound)
        assert Counter(map(tuple, got.collect())) == want
    assert decontaminate.contamination_report(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination_report(empty, bench).count() == 0
    kept = {r.doc_id: r.text for r in decontaminate.remove_contamination(df, bench).filter("doc_id >= 50").collect()}
    assert 51 not in kept and 53 not in kept and 52 not in kept and 50 not in kept
    removed = [Counter(map(tuple, decontaminate.remove_contamination(df, bench, max_chars=n).collect())) for n in (decontaminate.MAX_CHARS, 200, 60)]
    assert removed[0] == removed[1] == removed[2]
    long = spark.createDataFrame([(1, prose("y", 900) + " START " + q1 + " END")], "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("long"))
    cut = decontaminate.remove_contamination(long, bench, chars_col="n_chars").first()
    assert q1[:-1] not in cut.text and "START" in cut.text and cut.text.endswith("END") and cut.n_chars == len(cut.text)
