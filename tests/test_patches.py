from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import table_patches as P
from quillspark.operators import tables as B

T1 = ["| a | b |", "| --- | --- |", "| 1 | 2 |"]
T2 = ["| c | d |", "| --- | --- |", "| 3 | 4 |"]
TEXT = ["<!-- page 1 -->", "표 1.1-1", *T1, "<!-- page 2 -->", "words", *T2, "", "x  1  2", "y  3  4"]


def test_locate():
    assert P.locate(TEXT, number=1) == (7, 10) and P.locate(TEXT, number=2) == (11, 13) and P.locate(TEXT, number=9) is None
    assert P.locate(TEXT, number=0, page=2) == (7, 10)
    assert P.locate(TEXT, label="표1.1-1") == (2, 5)


def test_patch():
    assert P.patch(TEXT, T2, number=0)[2:5] == T2
    assert P.patch(["<!-- page 3 -->", "x"], T1, page=3) == ["<!-- page 3 -->", "", *T1, "", "x"]
    assert P.patch(["x"], T1, label="none") == ["x"]


def test_fuse():
    grid = B.grid(T1)
    assert P.fuse([grid], ["text", *T1], [[*T2]]) == ["text", *T1]
    assert P.fuse([grid], ["cap", "end"], [["cap", *T1]]) == ["cap", "", *T1, "", "end"]
    broken = ["| a | b |", "| --- | --- |", "| 9 | 8 |"]
    assert P.fuse([grid], broken, [T1]) == T1


def test_spans():
    html = "<table><tr><th>n</th><th>v</th></tr><tr><td rowspan=2>a</td><td>1</td></tr><tr><td>2|3</td></tr></table>"
    assert B.html_table(html) == "| n | v |\n| --- | --- |\n| a | 1 |\n| a | 2\\|3 |"


def test_grounding_and_html(spark):
    rows = P.grounding(spark.createDataFrame([(1, "\n".join(TEXT))], "id int, text string"), ["id"], "text").orderBy("start").collect()
    assert [(r.start, r.end, r.page, r.page_index) for r in rows] == [(2, 5, 1, 0), (7, 10, 2, 0)]
    got = spark.createDataFrame([([["a<", "b"]],)], "r array<array<string>>").select(P.rows_html(F.col("r")).alias("h")).first().h
    assert got == "<table><tr><td>a&lt;</td><td>b</td></tr></table>"
