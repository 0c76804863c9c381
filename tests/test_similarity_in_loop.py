"""The registered repair queries on a small fixture, with sequence similarity by brute force."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import line_repair as R
from quillspark.operators import metrics as M
from quillspark.plans import planner as P
from quillspark.plans.queries import DOC, damaged


def ratio(a: str, b: str) -> float:
    a, b = (re.sub(r"\s+", " ", x).strip().lower() for x in (a, b))
    return SequenceMatcher(None, a, b).ratio()


def test_repairs_use_the_similarity(spark, tmp_path):
    texts = ["\n".join(f"Line {i} of {k} says word{i * k} twice" for i in range(n)) for k, n in ((1, 4), (2, 9), (3, 16))]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    pairs = [tuple(r) for r in damaged(spark, folder).withColumn("after", R.collapse_blank_lines(F.col("candidate"))).select("doc_id", "source", "candidate", "after").collect()]
    rows = spark.createDataFrame([(*p, ratio(p[1], p[2]), ratio(p[1], p[3])) for p in pairs], "doc_id bigint, source string, candidate string, after string, s double, t double")
    before = M.evaluate(rows, DOC, similarity=F.col("s"))
    after = M.evaluate(rows.withColumn("candidate", F.col("after")), DOC, similarity=F.col("t"))
    first, second = ({r.doc_id: r for r in x.select("doc_id", "total_score").collect()} for x in (before, after))
    known = registry.queries()

    outcomes = {r.doc_id: r.score_delta for r in known["repair_outcomes"](spark, folder).collect()}
    assert {k: round(v, 6) for k, v in outcomes.items()} == {k: round(second[k].total_score - first[k].total_score, 6) for k in first}

    want = before.withColumn("content", F.col("candidate"))
    given = P.inputs(want, is_pdf=F.col("doc_id") % 2 == 0)  # as the query has it
    want = {r[0]: r[1] for r in want.select("doc_id", F.array_join(F.transform(P.directives(given), lambda x: x["issue_type"]), ",")).collect()}
    assert {r.doc_id: r.directives for r in known["directives"](spark, folder).collect()} == want

    history = known["repair_loop"](spark, folder).collect()
    assert {r.doc_id: round(r.total_score, 9) for r in history if r["round"] == 0} == {k: round(r.total_score, 9) for k, r in first.items()}
