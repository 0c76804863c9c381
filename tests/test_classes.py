"""Evaluation by source class, and each directive fired once in the loop."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import metrics as M
from quillspark.operators import similarity as X
from quillspark.plans import loop
from quillspark.plans import planner as P
from quillspark.sources import filetype as K

SCHEMA = "id bigint, source string, candidate string, kind string, toc double, cells double"


def measured(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    out = M.evaluate(df, ["id"], source_class=F.col("kind"), toc_coverage=F.col("toc"), cell_similarity=F.col("cells"))
    return [r for r in out.orderBy("id").collect()]


def test_pdf_structure_is_cues_or_outline(spark):
    source = "1.1 Scope\nwords here\n1.2 Terms\nmore words\n2.1 Methods"
    rows = measured(spark, (source, "1.1 Scope\n2.1 Methods", "pdf", None, None), (source, "1.1 Scope\n2.1 Methods", "pdf", 0.9, None), (source, "1.1 Scope\n2.1 Methods", "text", None, None), ("plain\nlines", "plain\nlines", "pdf", None, None))
    assert [round(r.structure_retention, 6) for r in rows] == [0.666667, 0.9, 0.7, 1.0]


def test_pdf_tables_fall_back_to_cells_without_labels(spark):
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    unlabelled, labelled = "no numbers here", "표 4-1 values 1 2"
    rows = measured(spark, (unlabelled, table, "pdf", None, 0.83), (labelled, table, "pdf", None, 0.83), (unlabelled, table, "text", None, 0.83))
    assert rows[0].table_preservation == pytest.approx(0.83) and rows[1].table_preservation == 0.0 and rows[2].table_preservation == 0.0


def test_uneven_tables_lower_the_score(spark):
    even = "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    ragged = even.replace("| 3 | 4 |", "| 3 |")
    rows = measured(spark, (even, even, "text", None, None), (even, ragged, "text", None, None))
    assert rows[0].table_preservation == 1.0
    share = 3 / 4
    assert rows[1].table_consistency == share and rows[1].table_preservation == pytest.approx(0.7 + 0.3 * share)
    assert "column structure inconsistent (consistency=0.75)" in " ".join(rows[1].notes)


def test_structured_sources_ignore_marks_that_were_added(spark):
    rows = measured(spark, ("Title\na\nb", "# Title\n\n- a\n- b", "structured", None, None), ("Title\na\nb", "# Title\n\n- a\n- b", "text", None, None), ("# T\n- a", "- a", "structured", None, None))
    assert (rows[0].structure_retention, rows[0].table_preservation, rows[0].normalized_similarity) == (1.0, 1.0, 1.0)
    assert rows[1].structure_retention < 1 and rows[1].normalized_similarity < 1
    assert rows[2].structure_retention < 1


def test_long_streams_are_compared_by_tokens(spark):
    a = " ".join(f"w{i}" for i in range(6000))
    b = " ".join(f"w{i}" for i in range(3000, 9000))
    df = spark.createDataFrame([(a, b), ("a b", "a  B"), ("", "x"), (None, "x")], "s string, c string")
    got = [r[0] for r in df.select(X.content_similarity(F.col("s"), F.col("c"))).collect()]
    assert got[:3] == [pytest.approx(0.5), 1.0, 0.0] and got[3] is None


def test_source_class(spark):
    paths = ["a.PDF", "b.docx", "c.md", "d.png", "e.csv", "f"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(K.source_class(K.media_type(F.col("p")), F.col("p"))).collect()] == ["pdf", "structured", "text", "text", "structured", "text"]


HEAD = "| part | value |\n| --- | --- |"
#: One text for each directive: (issue type, class, source, candidate, changed text holds, and no longer holds).
CASES = [
    ("image_link_noise", "text", "words " * 30, "![x](y.png)\nwords", None, "y.png"),
    ("missing_table_caption", "text", "Intro line\nTable 1 Values\nbody of it\nlast", "Intro line\nbody of it", "Table 1 Values", None),
    ("text_coverage_missing_paragraphs", "pdf", "Intro line\nMany other words stand here entirely lost\nlast", "Intro line\nlast", "Many other words stand here entirely lost", None),
    ("table_cross_parser_fusion", "pdf", "numbers 1 2 3\nmore text that is lost", "text", "| alpha | 10 |", None),
    ("text_coverage_missing_lines", "text", "Intro line\n# Lost heading\nbody of it\nother words gone now entirely and more", "Intro line\nbody of it", "# Lost heading", None),
    ("table_layout_noise", "text", "words of it " * 20, "a | b | c ![i](j.png) x", "| a | b | c x |", None),
    ("table_text_block_recovery", "text", HEAD + "\n| a | 1 |" * 9, "name: one\nsize: 2\nrest", "| name | one |", None),
    ("structure_toc_headings", "pdf", "1.1 A\n1.2 B\n1.3 C\n1.4 D words", "<!-- page 1 -->\nFirst title\nwords", "## First title", None),
    ("structure_heading_noise", "text", "other words " * 30, "# Same\nx\n# same\ny", None, "# same"),
    ("blank_line_noise", "text", "lost words " * 30, "a\n\n\n\nb", "a\n\nb", "\n\n\n"),
    ("pdf_header_footer_noise", "pdf", "lost words " * 30, "<!-- page 1 -->\nRunning head\nbody one\nx1\n<!-- page 2 -->\nRunning head\nbody two\nx2", None, "Running head"),
    ("boundary_repetition_noise", "text", "lost words " * 30, "Same head\n\nbody text\n\nSame head\n\nmore text", None, "Same head"),
    ("line_repetition_noise", "text", "lost words " * 30, "A longer line of words.\nA longer line of words.\nEnd.", "A longer line of words.\nEnd.", None),
    ("wrapped_line_noise", "text", "lost words " * 30, "A line that was\nwrapped here.", "A line that was wrapped here.", None),
    ("pdf_block_boundary_noise", "pdf", "1.1 A\n1.2 B\n1.3 C\n1.4 D " + "lost words " * 30, "Text\n1. Section one\nText two", "Text\n\n1. Section one", None),
]


def test_every_directive_fires_and_changes_the_text(spark):
    grid = [[["part", "value"], ["alpha", "10"], ["beta", "20"]]]
    pool = ["before\n" + HEAD + "\n| alpha | 10 |\n| beta | 20 |"]
    toc = [(2, "First title", 1), (2, "Second one", 1), (3, "Third one", 1)]
    schema = "id bigint, source string, candidate string, source_class string, toc array<struct<level:int,title:string,page:int>>, references array<array<array<string>>>, alternates array<string>"
    rows = [(i, s, c, kind, toc if "toc" in name else [], grid if "fusion" in name else None, pool if "fusion" in name else []) for i, (name, kind, s, c, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, schema)
    history = loop.run(df, ["id"], rounds=1, similarity=F.lit(0.2))
    got = {r.id: r for r in history.filter("round = 1").collect()}
    actions = {d.issue_type: d.action_name for d in P.CATALOGUE}
    assert [c[0] for c in CASES] == [d.issue_type for d in P.CATALOGUE]
    for i, (name, *_, there, gone) in enumerate(CASES):
        assert actions[name] in got[i].applied, (name, got[i].applied)
        assert there is None or there in got[i].candidate, (name, got[i].candidate)
        assert gone is None or gone not in got[i].candidate, (name, got[i].candidate)


def test_targets(spark):
    m = {k: F.lit(v) for k, v in {"text_coverage": 0.5, "structure_retention": 1.0, "table_preservation": 0.6, "empty_block_penalty": 0.2, "repetition_penalty": 0.0}.items()}
    df = spark.range(3).withColumn("content", F.lit("a\n\n\nb"))
    given = P.inputs(df, **m, table_cell_similarity=F.when(F.col("id") == 2, 0.9))
    findings = F.when(F.col("id") == 0, F.array(F.struct(F.lit("missing_header").alias("issue_type"), F.lit("표 1-1").alias("table_label"), F.lit(3).alias("page_number")))).otherwise(F.array().cast("array<struct<issue_type:string,table_label:string,page_number:int>>"))
    regions = F.array(F.struct(F.lit("표 2-1").alias("label"), F.lit(4).alias("page_number")), F.struct(F.lit("표 2-1").alias("label"), F.lit(4).alias("page_number")))
    rows = df.select("id", P.targets(given, M.metric_issues(m), findings, regions, F.array(F.lit("merged_cell_loss"))).alias("t")).orderBy("id").collect()
    kinds = [[(t.issue_type, t.source_name, t.repairability) for t in r.t] for r in rows]
    own = [("table_layout_noise", "quality_inspection", "heuristic"), ("blank_line_noise", "quality_inspection", "heuristic")]
    content = ("text_coverage_missing_content", "coverage_metric", "llm")
    assert kinds[0] == [*own, ("missing_header", "judge_table_finding", "visual"), ("merged_cell_loss", "metrics_table_issue", "visual"), content]
    assert kinds[1] == [*own, ("merged_cell_loss", "parser_table_region", "visual"), content]
    assert kinds[2] == [*own, content]
    table, blank = rows[0].t[:2]
    assert (table.target_kind, table.severity, table.confidence, table.expected_gain, table.estimated_cost, table.risk_level) == ("table", "medium", pytest.approx(0.4), pytest.approx(0.16), 0.0, "low")
    assert (blank.target_kind, blank.severity, blank.expected_gain) == ("document", "medium", pytest.approx(0.04))
    assert (rows[0].t[-1].expected_gain, rows[0].t[-1].severity, rows[0].t[2].page_number) == (pytest.approx(0.25), "high", 3)
