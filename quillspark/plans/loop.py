"""The bounded repair loop: evaluate, plan, repair, evaluate again, keep the best.

Each round is one plan over all documents that still need repair.  Rounds are
few (``MAX_ROUNDS``); every round is written to the shared folder and read again, so
lineage stays short and a lost executor repeats one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as T
from quillspark.operators import folds, tables
from quillspark.operators import metrics as M
from quillspark.operators import recovery as V
from quillspark.plans import planner as P
from quillspark.storage import discard, shared_folder, written


def _named(issue_type: str):
    return lambda x: x["issue_type"] == issue_type


def repair_once(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Apply the directives of ``rows.plan`` to ``candidate`` in order; ``applied`` lists those that changed it.

    Neighbouring native steps are one expression that binds each step's text once.  A
    step in Arrow batches, or one that joins lines, ends a stage, which is written, so plans do not multiply.
    """
    rest = [c for c in rows.columns if c != "candidate"]
    out = rows.withColumn("applied", F.array().cast("array<string>"))
    state = F.struct(F.col("candidate").alias("text"), F.col("applied").alias("applied"))

    def stage(df: DataFrame, steps: list[P.Directive]) -> DataFrame:
        s = state
        for d in steps:
            s = T.let(s, _native(d))
        return df.select(*rest, s.alias("s")).select(*rest, F.col("s.text").alias("candidate"), F.col("s.applied").alias("applied"))

    def _native(d: P.Directive):
        asked = F.exists("plan", _named(d.issue_type))
        return lambda s: T.let(F.when(asked, d.apply(s["text"])).otherwise(s["text"]), _noted(s, d.action_name))

    def changed(df: DataFrame, d: P.Directive) -> DataFrame:
        """df with the step's text as ``next``."""
        if d.frame is not None:
            asked = df.filter(F.exists("plan", _named(d.issue_type))).select(*keys, "source", "candidate")
            return df.join(d.frame(asked, keys).withColumnRenamed("recovered", "next"), keys, "left").withColumn("next", F.coalesce("next", "candidate"))
        return df.withColumn("next", d.apply(F.col("candidate")) if d.apply is not None else d.row())

    native: list[P.Directive] = []
    for k, d in enumerate(P.CATALOGUE):
        if not set(d.needs) <= set(rest):
            continue
        if d.apply is not None and not d.in_python:
            native.append(d)
            continue
        out = stage(out, native) if native else out
        native = []
        after = F.when(F.exists("plan", _named(d.issue_type)), F.col("next")).otherwise(F.col("candidate"))
        noted = F.when(after != F.col("candidate"), F.concat("applied", F.array(F.lit(d.action_name)))).otherwise(F.col("applied"))
        out = written(changed(out, d).select(*rest, after.alias("candidate"), noted.alias("applied")), f"{folder}/{k}")
    return stage(out, native) if native else out


def _noted(before, name: str):
    return lambda text: F.struct(text.alias("text"), F.when(text != before["text"], F.concat(before["applied"], F.array(F.lit(name)))).otherwise(before["applied"]).alias("applied"))


#: Columns that tell more of a source; what is not there counts as unknown.
OPTIONAL = ["source_class", "toc", "references", "alternates", "n_table_issues"]


def run(df: DataFrame, keys: list[str], rounds: int = S.MAX_ROUNDS, similarity=None) -> DataFrame:
    """keys, round, total_score, is_best, rolled_back, applied, candidate for every round of every document.

    df: keys, source, candidate, and of ``OPTIONAL`` what is known: source_class; toc (array of level, title, page);
    references (grids of the source's tables); alternates (other candidates' texts); n_table_issues.
    """
    folder, known = shared_folder(df.sparkSession, "repair-loop"), [c for c in OPTIONAL if c in df.columns]

    def scored(rows: DataFrame, k: int) -> DataFrame:
        toc = V.title_share(F.transform("toc", lambda e: e["title"]), F.col("candidate")) if "toc" in known else None
        cells = tables.grids_similarity("references", "candidate") if "references" in known else None
        kind = F.col("source_class") if "source_class" in known else None
        out = M.evaluate(rows, keys, similarity=similarity, source_class=kind, toc_coverage=toc, cell_similarity=cells)
        return written(out.withColumn("round", F.lit(k)), f"{folder}/round-{k}")

    columns = [*keys, "round", "total_score", "applied", "candidate"]
    state = scored(df.select(*keys, "source", "candidate", *known, F.array().cast("array<string>").alias("applied")), 0)
    history = state.select(*columns)
    for k in range(1, rounds + 1):
        n_issues = F.col("n_table_issues") if "n_table_issues" in known else F.lit(0)
        todo = state.filter(P.needs_repair(F.lit(k - 1), F.col("gate_failures"), n_issues))
        todo = P.flagged(todo, keys, F.col("source_class") if "source_class" in known else None, n_issues)
        planned = todo.withColumn("plan", P.directives(P.inputs(todo, content=F.col("candidate")))).filter(F.size("plan") > 0)
        planned = written(planned.select(*keys, "source", "candidate", *known, "plan"), f"{folder}/plan-{k}")
        repaired = repair_once(planned, keys, f"{folder}/steps-{k}").filter(F.size("applied") > 0)
        state = scored(repaired.select(*keys, "source", "candidate", *known, "applied"), k)
        discard(df.sparkSession, f"{folder}/plan-{k}", f"{folder}/steps-{k}")  # only rounds are read again
        history = history.unionByName(state.select(*columns))
        if state.isEmpty():
            break
    return P.keep_best(history, keys)


def finalize(history: DataFrame, keys: list[str]) -> DataFrame:
    """The best round's text after table normalisation, with its score and steps."""
    best = history.groupBy(*keys).agg(F.max_by(F.struct("round", "total_score", "candidate"), F.struct("total_score", "round")).alias("b"), F.max("round").alias("rounds"))
    rows = best.select(*keys, "rounds", "b.round", "b.total_score", folds.normalized_tables("b.candidate").alias("n"))
    return rows.select(*keys, "rounds", "round", "total_score", F.col("n.text").alias("text"), F.col("n.applied").alias("normalizations"))
