"""Steps that must stay near the size of their input, with the results of the plain way."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import pytest

ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz    eeeetttaaooiinnss", "한국어로된아주길고끝나지않는문장이여기에서 ", "".join(map(chr, range(0x4E00, 0x4E00 + 300))), "0123456789abcdef\U0001f600 "]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_ratio_is_the_matchers(alphabet, monkeypatch):
    from quillspark.operators import matching

    monkeypatch.setattr(matching, "SHORT", -1)
    r = random.Random(len(alphabet))
    for n in (0, 1, 20, 199, 200, 260, 900) * 12:
        a = "".join(r.choices(alphabet, k=n))
        b = list(a)
        for _ in range(r.choice([0, 1, 5])):
            i, k = r.randrange(len(b) + 1), r.randrange(1, 40)
            b[i : i + k] = r.choice([[], b[max(0, i - k) : i], r.choices(alphabet, k=2)])
        b = "".join(b)
        for x, y in ((a, b), (b, a)):
            assert matching.ratio(x, y) == SequenceMatcher(None, x, y).ratio()


def test_ratio_of_long_texts_is_no_search_over_pairs():
    from quillspark.operators.matching import ratio

    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkjqxz", weights=range(26, 0, -1), k=r.randrange(2, 9))) for _ in range(3000)]
    lines = [" ".join(r.choices(words, k=90)) for _ in range(300)]
    a, b = "\n".join(lines), "\n".join(x for i, x in enumerate(lines) if i % 5 != 3)
    began = time.process_time()
    assert 0 < ratio(a, b) < 1
    assert time.process_time() - began < 5


def against_sql(spark, tmp_path, name, texts):
    """Rows of a query over documents, and of its SQL."""
    import duckdb

    from quillspark import registry

    folder = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = registry.queries()[name](spark, folder)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=str), sorted(want.fetchall(), key=str)


#: Texts whose last lines are blank, repeated, or both; empty and missing ones.
ENDS = ["A\nA", "A\nb\nc\nd\nA", "A\n\n\nA\n", "A", "\n", "", None, "A\n\n", "x y\nX Y\n\n \nx y", "\n\nA\na\n\n", "A\nB\nC\nD\nE\nF\nG\nG\n\nG"]


def test_repeated_last_lines(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "remove_repeated_lines", ENDS)
    assert got == want


@pytest.mark.parametrize("name", ["line_covered", "page_token_coverage", "content_f1", "text_coverage", "quality_gate", "aggregate_score", "evaluation", "html_evaluation", "directives"])
def test_tokens_are_counted_in_their_row(spark, name):
    from quillspark import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lost_kinds_are_those_of_the_lines(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import recovery as V

    pairs = [("# A\ntext\n표 1 b", "text"), ("# A\ntext\n표 1 b", "other"), ("# A\ntext", "# a\ntext"), ("plain\ntext", "text"), ("", ""), ("# A\n\n- b", "\n- b"), (None, "x"), ("표 1 b\nx", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "doc_id int, source string, candidate string")
    lost = V.missing_lines(df, ["doc_id"], "source", "candidate").groupBy("doc_id").agg(F.max(V.caption(F.col("line"))).alias("c"))
    want = {r.doc_id: (True, r.c) for r in lost.collect()}
    got = df.select("doc_id", V.lost_kinds(F.col("source"), F.col("candidate")).alias("k")).select("doc_id", "k.*").collect()
    assert {r.doc_id: (bool(r.lines), bool(r.captions)) for r in got} == {i: want.get(i, (False, False)) for i in range(len(pairs))}


def test_shared_expressions_are_computed_once(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import grids as G
    from quillspark.functions import scores as S
    from quillspark.plans import visual as W

    df = spark.createDataFrame([([["a", "b"], ["c", None]], "x")], "rows array<array<string>>, t string")
    times = lambda c, what: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count(what)
    assert times(G.markdown(F.col("rows")), "regexp_replace") == 1
    assert times(S.count_similarity(F.length(F.reverse("t")), F.length(F.upper("t"))), "reverse") == 1
    assert times(S.clamp(F.length(F.reverse("t")).cast("double")), "reverse") == 1
    assert times(W.spread(F.split(F.reverse("t"), ""), 3), "reverse") == 1
    assert df.select(G.markdown(F.col("rows"))).first()[0] == "| a | b |\n| --- | --- |\n| c |  |"


def test_cell_ratio_is_the_matchers():
    from quillspark.operators.tables import cell_similarity

    r = random.Random(3)
    for alphabet in ("01", "0123456789", "ab c") * 300:
        a, b = ("".join(r.choices(alphabet, k=r.randrange(1, 45))) for _ in "ab")
        assert cell_similarity(a, b) == SequenceMatcher(None, a, b).ratio()


def test_recovered_last_lines(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "recover_lines", ENDS)
    assert got == want
