from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import folds, golden, metrics
from quillspark.operators import line_repair as R
from quillspark.operators import similarity as X
from quillspark.plans import loop
from quillspark.plans import planner as P
from quillspark.sources import sinks
from quillspark.streaming import usage


def ask(spark, make, *texts):
    names = [f"c{k}" for k in range(len(texts))]
    return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(make(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "before", "after"),
    [
        (R.collapse_blank_lines, "a\n\n \n\nb\n", "a\n\nb\n"),
        (R.remove_repeated_lines, "A\n\na\nb\na", "A\n\nb\na"),
        (R.remove_duplicate_headings, "# T\nx\n## t\ny", "# T\nx\ny"),
        (R.strip_images, "a ![x](y.png) b\n![z](w)\nc", "a b\nc"),
        (R.normalize_table_layout, "|a|b|\nx|y\n|c ![i](j)|d|", "| a | b |\nx|y\n| c | d |"),
        (R.remove_boundary_lines, "Head\n\nlong body text one\n\nHead\n\nmore", "long body text one\n\nmore"),
        (R.collapse_blank_lines, "", ""),
    ],
)
def test_line_repairs(spark, make, before, after):
    assert ask(spark, make, before) == after


@pytest.mark.parametrize("make", [R.collapse_blank_lines, R.remove_repeated_lines, R.remove_duplicate_headings, R.strip_images, R.normalize_table_layout])
def test_repairs_are_idempotent(spark, make):
    text = "# A\n\n\n# a\n|x|y|\n|x|y|\nz ![i](j)  k\nz\n"
    once = ask(spark, make, text)
    assert ask(spark, make, once) == once


def test_wrapped_lines(spark):
    assert folds.merge_wrapped(["This is long and", "goes on", "Next.", "end-", "ing here"]) == ["This is long and goes on", "Next.", "ending here"]
    korean = ["이것은 충분히 길어서 다음 줄로 이어지는 문장의 앞부분", "이어서 계속된다", "끝났습니다", "다음"]
    assert folds.merge_wrapped(korean)[0].endswith("이어서 계속된다")
    assert ask(spark, R.has_wrapped_lines, "one two\nthree") and not ask(spark, R.has_wrapped_lines, "one.\nthree")


def test_native_and_python_predicates_agree(spark):
    samples = ["# a", "- x", "(1) y", "1. z", "표 3", "| a | b |", "plain text", "12", "제 1 장 x", "a | b | c", ""]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", T.structural(F.col("s")).alias("x")).collect()
    assert {r.s: r.x for r in rows} == {s: folds.structural(s) for s in samples}


TABLE = ["| a | b |", "| --- | --- |", "| 1 | 2 |"]


def test_split_tables_merge():
    parts = [*TABLE, "", "<!-- page 2 -->", "(계속)", *TABLE[:2], "| 3 | 4 |"]
    assert folds.merge_split_tables(parts) == [*TABLE, "| 3 | 4 |", "", "<!-- page 2 -->"]
    assert folds.merge_split_tables([*TABLE, "", "| c | d |", TABLE[1], "| 3 | 4 |"]) == [*TABLE, "| c | d |", "| 3 | 4 |"]
    for other in ([*TABLE, "text", *TABLE], [*TABLE, "", "| a | b | c |"]):
        assert folds.merge_split_tables(other) == other


def test_tables():
    fused = [*TABLE, "| 표 2.4-2 | |", "| c | d |", TABLE[1], "| 3 | 4 |"]
    assert folds.split_fused_tables(fused)[3:6] == ["", "표 2.4-2", ""]
    assert folds.fill_leading_cells(["| x | y | z |", "|---|---|---|", "| a | b | 1 |", "|  |  | 2 |"])[-1] == "| a | b | 2 |"
    big = ["| name | value |", "| --- | --- |", "| alpha | 111 |", "| beta | 222 |"]
    assert folds.remove_duplicate_tables([*big[2:], "", *big]) == ["", *big]
    assert folds.remove_remnants(["alpha 111 beta 222 name value", *big, "unrelated words that stay here please"]) == [*big, "unrelated words that stay here please"]
    assert folds.reconstruct_tables(["Info", "name: x", "size: 3", "end"]) == ["Info", "| 항목 | 값 |", "| --- | --- |", "| name | x |", "| size | 3 |", "end"]


def test_page_edges():
    pages = ["<!-- page 1 -->", "Report", "one", "<!-- page 2 -->", "Report", "two"]
    assert folds.remove_page_edges(pages) == ["<!-- page 1 -->", "one", "<!-- page 2 -->", "two"]
    assert folds.remove_page_edges(["no", "pages"]) == ["no", "pages"]


def test_fusion_and_toc():
    source = ["first line of the text", "a lost paragraph with many words", "last line of the text"]
    assert folds.fuse_body(source, [source[0], source[2]]) == [source[0], "", source[1], source[2]]
    toc = [{"level": 1, "title": "Intro", "page": 1}, {"level": 2, "title": "Lost", "page": 2}]
    assert folds.restore_toc(["intro", "<!-- page 2 -->", "x"], toc) == ["# Intro", "<!-- page 2 -->", "", "## Lost", "", "x"]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, "# a\n- b\n| c | d |\ntext here", "# a\n- b\n| c | d |\ntext here"), (2, "alpha beta gamma", ""), (3, "", "")], "id int, source string, candidate string")
    got = {r.id: r for r in metrics.evaluate(rows, ["id"]).collect()}
    assert got[1].total_score == pytest.approx(1.0) and got[1].issues == [] and got[1].gate_failures == []
    assert got[2].text_coverage == 0.0 and "text_coverage" in got[2].gate_failures
    assert got[3].text_coverage == 1.0


def test_similarity(spark):
    assert ask(spark, X.text_similarity, "A  b", "a b") == 1.0
    assert ask(spark, X.content_similarity, "**a:** b", "a b") == 1.0
    assert ask(spark, X.text_similarity, "tide", "diet") == 0.25


def test_keep_best(spark):
    rounds = spark.createDataFrame([("d", 0, 0.8), ("d", 1, 0.55), ("d", 2, 0.9)], "id string, round int, total_score double")
    got = {r["round"]: r for r in P.keep_best(rounds, ["id"]).collect()}
    assert got[1].rolled_back and got[2].is_best and got[2].best_score == 0.9


def test_repair_loop(spark):
    text = "# One\n\n\n\n# one\nbody text that is fine.\n![x](y)\n"
    rows = spark.createDataFrame([("d", "One\nbody text that is fine.", text)], "id string, source string, candidate string")
    history = loop.run(rows, ["id"], similarity=F.lit(0.2))
    final = loop.finalize(history, ["id"]).first()
    assert "![x]" not in final.text and "\n\n\n" not in final.text and final.text.count("# ") == 1


def test_spearman(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31)], "a int, b int")
    assert golden.spearman(rows, "a", "b").first().rho == pytest.approx(0.9486832980505138)
    assert golden.spearman(rows.withColumn("a", F.lit(1)), "a", "b").first().rho == 0.0


def test_stream(spark, tmp_path):
    schema = "ts timestamp, stage string, duration_ms bigint"
    spark.createDataFrame([("2024-01-01 00:10:00", "judge", 5), ("2024-01-01 00:20:00", "judge", 7)], "ts string, stage string, duration_ms bigint").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"file://{tmp_path}/calls")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/calls")
    q = usage.start(stream, "usage", checkpointLocation=f"file://{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert spark.table("usage").first().duration_ms == 12


def test_feedback(spark, tmp_path):
    folder = f"file://{tmp_path}/feedback"
    sinks.append_feedback(spark.createDataFrame([(1, "r", 0.5, ["table"], [])], "seq bigint, run_id string, total_score double, issues array<string>, notes array<string>"), folder)
    (tmp_path / "feedback" / "bad.json").write_text("{broken\n")
    assert sinks.read_feedback(spark, folder).count() == 1
