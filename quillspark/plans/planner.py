"""From metrics to repair directives, targets, plan steps and outcomes.

All of it is expressions and aggregates over one row per document and round, so a plan for
a billion documents is one scan and, for plan steps, one aggregation by document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions import scores as S
from quillspark.functions import text as T
from quillspark.operators import folds, table_patches
from quillspark.operators import line_repair as R
from quillspark.operators import recovery as V

VISUAL, LLM, HEURISTIC = "visual_table_repair", "llm_text_repair", "heuristic"
VISUAL_ROUTE = "recover_tables_from_pdf_image"
# Fixed fallbacks for plan steps without own numbers.
GAIN = {VISUAL: 0.08, LLM: 0.05, HEURISTIC: 0.03}
COST = {VISUAL: 1.0, LLM: 0.5, HEURISTIC: 0.0}


@dataclass(frozen=True)
class Directive:
    """One rule: when it fires and what it does to the text.

    ``apply``: an expression over the text.  ``row``: one over the row, which needs the columns ``needs``
    beside source and candidate; without them the text stays.  ``frame``: rows (keys, source, candidate) to (keys, recovered).
    """

    issue_type: str
    route_name: str
    action_name: str
    when: Callable[[dict[str, Column]], Column]
    apply: Callable[[Column], Column] | None = None
    in_python: bool = False
    row: Callable[[], Column] | None = None
    needs: tuple[str, ...] = ()
    frame: Callable[[DataFrame, list[str]], DataFrame] | None = None


def _low(name: str, limit: float) -> Callable[[dict[str, Column]], Column]:
    return lambda m: m[name] < limit


def _pdf(rule: Callable[[dict[str, Column]], Column]) -> Callable[[dict[str, Column]], Column]:
    return lambda m: m["is_pdf"] & rule(m)


#: In the order in which they are applied; one per issue type.
CATALOGUE = [
    Directive("image_link_noise", "remove_image_noise", "strip_markdown_images", lambda m: R.has_images(m["content"]), R.strip_images),
    Directive("missing_table_caption", "recover_missing_table_captions", "recover_missing_table_caption_lines", lambda m: m["missing_captions"], frame=lambda df, keys: V.recover_lines(df, keys, "source", "candidate", V.caption)),
    Directive("text_coverage_missing_paragraphs", "fuse_missing_body_from_source", "fuse_missing_body_lines", _pdf(_low("text_coverage", 0.9)), row=lambda: folds.body_fused("source", "candidate")),
    Directive("table_cross_parser_fusion", "fuse_tables_from_alternate_parser", "fuse_tables_from_alternate", _pdf(lambda m: F.coalesce(m["table_cell_similarity"] < 0.7, F.lit(False)) | (m["table_preservation"] < 0.75)), row=lambda: table_patches.fused("references", "candidate", "alternates"), needs=("references", "alternates")),
    Directive("text_coverage_missing_lines", "recover_missing_source_lines", "recover_missing_structured_source_lines", lambda m: (m["text_coverage"] < 0.72) & m["missing_lines"], frame=lambda df, keys: V.recover_lines(df, keys, "source", "candidate")),
    Directive("table_layout_noise", "normalize_table_layout", "normalize_table_layout", lambda m: ~m["defer_tables"] & ((m["table_preservation"] < 0.75) | R.has_layout_noise(m["content"])), R.normalize_table_layout),
    Directive("table_text_block_recovery", "reconstruct_table_blocks", "reconstruct_table_text_blocks", lambda m: ~m["defer_tables"] & (m["table_preservation"] < 0.75) & R.has_key_value_run(m["content"]), folds.column(folds.reconstruct_tables), in_python=True),
    Directive("structure_toc_headings", "restore_headings_from_toc", "restore_headings_from_toc", _pdf(_low("structure_retention", 0.75)), row=lambda: folds.toc_restored("candidate", "toc"), needs=("toc",)),
    Directive("structure_heading_noise", "deduplicate_headings", "remove_duplicate_headings", lambda m: (m["structure_retention"] < 0.75) | R.has_duplicate_headings(m["content"]), R.remove_duplicate_headings),
    Directive("blank_line_noise", "collapse_blank_runs", "collapse_blank_lines", lambda m: m["empty_block_penalty"] > 0, R.collapse_blank_lines),
    Directive("pdf_header_footer_noise", "deduplicate_pdf_headers", "remove_repeated_pdf_header_footer_lines", _pdf(lambda m: (m["repetition_penalty"] > 0) & m["page_edges"]), folds.column(folds.remove_page_edges), in_python=True),
    Directive("boundary_repetition_noise", "deduplicate_boundaries", "remove_repeated_boundary_lines", lambda m: m["repetition_penalty"] > 0, R.remove_boundary_lines),
    Directive("line_repetition_noise", "deduplicate_lines", "remove_repeated_lines", lambda m: m["repetition_penalty"] > 0, R.remove_repeated_lines),
    Directive("wrapped_line_noise", "merge_wrapped_lines", "merge_wrapped_lines", lambda m: R.has_wrapped_lines(m["content"]), folds.column(folds.merge_wrapped), in_python=True),
    Directive("pdf_block_boundary_noise", "restore_pdf_boundaries", "restore_pdf_boundaries", _pdf(lambda m: (m["structure_retention"] < 0.75) & m["boundaries_change"]), folds.column(folds.restore_boundaries), in_python=True),
]
BY_ISSUE = {d.issue_type: d for d in CATALOGUE}


FLAGS = ("is_pdf", "missing_captions", "missing_lines", "defer_tables", "page_edges", "boundaries_change")


def inputs(df: DataFrame, **given: Column) -> dict[str, Column]:
    """Metric and flag columns for the rules; flags that are not given are false."""
    own = {c: F.col(c) for c in df.columns}
    return {"table_cell_similarity": F.lit(None).cast("double")} | {k: F.lit(False) for k in FLAGS} | own | given


def flagged(df: DataFrame, keys: list[str], source_class: Column | None = None, n_table_issues: Column | None = None) -> DataFrame:
    """df (keys, source, candidate, ...) with the flags of :func:`inputs`, from its texts and its class."""
    c = F.col("candidate")
    pdf = (source_class if source_class is not None else F.lit("text")) == "pdf"
    rows = df.withColumn("is_pdf", pdf)
    rows = rows.withColumn("_lost", V.lost_kinds(F.col("source"), c))
    own = F.when(F.col("is_pdf"), c)
    no = F.lit(False)
    return rows.withColumns({
        "missing_lines": F.coalesce("_lost.lines", no), "missing_captions": F.coalesce("_lost.captions", no),
        "defer_tables": defer_tables(F.col("is_pdf"), n_table_issues if n_table_issues is not None else F.lit(0)),
        "page_edges": F.coalesce(folds.column(folds.remove_page_edges)(own) != own, no), "boundaries_change": F.coalesce(folds.column(folds.restore_boundaries)(own) != own, no),
    }).drop("_lost")


def directives(m: dict[str, Column]) -> Column:
    """Array of (issue_type, route_name, action_name) that fire, in catalogue order."""
    made = [F.when(d.when(m), F.struct(F.lit(d.issue_type).alias("issue_type"), F.lit(d.route_name).alias("route_name"), F.lit(d.action_name).alias("action_name"))) for d in CATALOGUE]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def defer_tables(is_pdf: Column, n_table_issues: Column) -> Column:
    return is_pdf & (n_table_issues > 0)


def target_kind(issue_type: Column) -> Column:
    """What a target of this type concerns; the types that judges find in tables concern tables."""
    found = issue_type.isin(list(L.TABLE_ISSUES))
    return F.when(issue_type.startswith("table_") | found, "table").when(issue_type.startswith("structure_") | issue_type.startswith("wrapped_"), "text").otherwise("document")


TARGET = "struct<target_kind:string,issue_type:string,route_name:string,source_name:string,severity:string,confidence:double,expected_gain:double,estimated_cost:double,risk_level:string,repairability:string,table_label:string,page_number:int>"
#: Fixed: tables whose cells are as like as this need no other look at them.
HEALTHY_CELLS, LLM_COVERAGE = 0.8, 0.72


def _issue(issues: Column, name: Column) -> Column:
    return F.get(F.filter(issues, lambda x: x["issue_type"] == name), F.lit(0))


def _target(issue_type: Column, route: Column, by: str, issues: Column, m: dict[str, Column], repairability: str, label: Column | None = None, page: Column | None = None) -> Column:
    """A target with gain, cost and risk; metrics of penalties count from 1."""
    visual = F.lit(repairability == "visual")

    def made(issue: Column) -> Column:
        value = F.coalesce(*(F.when(issue["metric_name"] == k, 1 - m[k] if k.endswith("penalty") else m[k]) for k in ("text_coverage", "structure_retention", "table_preservation", "empty_block_penalty", "repetition_penalty")))
        cost = S.cost_and_risk(visual, issue["confidence"])
        return F.struct(
            target_kind(issue_type).alias("target_kind"), issue_type.alias("issue_type"), route.alias("route_name"), F.lit(by).alias("source_name"), F.coalesce(issue["severity"], F.lit("medium")).alias("severity"),
            F.coalesce(S.clamp(issue["confidence"]), F.lit(S.DEFAULT_CONFIDENCE)).alias("confidence"), S.expected_gain(value, issue["confidence"], visual, m["table_preservation"]).alias("expected_gain"),
            cost["cost"].alias("estimated_cost"), cost["risk"].alias("risk_level"), F.lit(repairability).alias("repairability"), (label if label is not None else F.lit(None)).cast("string").alias("table_label"), (page if page is not None else F.lit(None)).cast("int").alias("page_number"),
        ).cast(TARGET)

    return T.let(_issue(issues, issue_type), made)


def targets(m: dict[str, Column], issues: Column, findings: Column, regions: Column, table_issues: Column) -> Column:
    """Array of targets: directives, table findings, else table regions, table issues left over, missing content.

    findings: array of (issue_type, table_label, page_number); regions: array of (label, page_number) from the
    parser; table_issues: array of types.  Tables are left alone where the cells are alike (``HEALTHY_CELLS``).
    """
    none = F.array().cast(f"array<{TARGET}>")
    healthy = F.coalesce(m["table_cell_similarity"] >= HEALTHY_CELLS, F.lit(False))
    found = F.when(healthy, F.slice(findings, 1, 0)).otherwise(findings)
    route = F.lit(VISUAL_ROUTE)
    own = F.transform(directives(m), lambda d: _target(d["issue_type"], d["route_name"], "quality_inspection", issues, m, "heuristic"))
    judged = F.transform(found, lambda x: _target(x["issue_type"], route, "judge_table_finding", issues, m, "visual", x["table_label"], x["page_number"]))
    places = F.array_distinct(F.filter(regions, lambda r: r["label"].isNotNull() | r["page_number"].isNotNull()))
    first = F.get(table_issues, F.lit(0))
    by_region = F.when(~healthy & (F.size(found) == 0) & (F.size(table_issues) > 0), F.transform(places, lambda r: _target(first, route, "parser_table_region", issues, m, "visual", r["label"], r["page_number"]))).otherwise(none)

    def rest(regional: Column) -> Column:
        covered = F.concat(F.transform(found, lambda x: x["issue_type"]), F.when(F.size(regional) > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
        left = F.when(healthy, F.slice(table_issues, 1, 0)).otherwise(F.array_except(table_issues, covered))
        return F.concat(regional, F.transform(left, lambda x: _target(x, route, "metrics_table_issue", issues, m, "visual")))

    cov = m["text_coverage"]
    content = F.struct(
        F.lit("text").alias("target_kind"), F.lit("text_coverage_missing_content").alias("issue_type"), F.lit("llm_restore_missing_content").alias("route_name"), F.lit("coverage_metric").alias("source_name"),
        F.when(cov < 0.55, "high").otherwise("medium").alias("severity"), F.bround(S.clamp(1.0 - cov), 4).alias("confidence"), F.bround(F.greatest(F.lit(0.05), 0.75 - cov), 4).alias("expected_gain"),
        F.lit(0.5).alias("estimated_cost"), F.lit("medium").alias("risk_level"), F.lit("llm").alias("repairability"), F.lit(None).cast("string").alias("table_label"), F.lit(None).cast("int").alias("page_number"),
    ).cast(TARGET)
    return F.concat(own, judged, T.let(by_region, rest), F.when(cov < LLM_COVERAGE, F.array(content)).otherwise(none))


def strategy(route: Column, repairability: Column, stalled: Column, attempted: Column, llm: bool = False) -> Column:
    """Visual route, LLM if available and asked or the heuristic stalled, else heuristic."""
    out = F.when(route == VISUAL_ROUTE, VISUAL)
    if llm:
        again = stalled & F.array_contains(attempted, route) & ~F.array_contains(attempted, F.concat(F.lit("llm:"), route))
        out = out.when((repairability == "llm") | again, LLM)
    return out.otherwise(HEURISTIC)


def stalled(iteration: Column, delta: Column) -> Column:
    return F.coalesce((iteration >= 1) & (delta < S.STALL_DELTA), F.lit(False))


def skip_target(route: Column, is_stalled: Column, attempted: Column, llm: bool = False) -> Column:
    """Stalled, tried before, not visual, and no promotion to the LLM is left."""
    out = (route != VISUAL_ROUTE) & is_stalled & F.array_contains(attempted, route)
    return out & F.array_contains(attempted, F.concat(F.lit("llm:"), route)) if llm else out


def priority(strategy_name: Column, is_stalled: Column) -> Column:
    rank = F.when(strategy_name == VISUAL, 0).when(strategy_name == HEURISTIC, 1).otherwise(2)
    return F.when(is_stalled, rank).otherwise(F.when(strategy_name == HEURISTIC, 0).otherwise(1))


def verification_rule(strategy_name: Column) -> Column:
    return F.when(strategy_name == VISUAL, "table_preservation_or_score_improves").otherwise("score_delta_non_negative")


def plan_steps(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Steps by (strategy, route) in order.

    targets: keys, strategy, route_name, expected_gain, estimated_cost, risk, confidence, iteration, score_delta.
    """
    fallback = lambda of: F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("strategy")]
    gain = F.when(F.col("expected_gain") > 0, F.col("expected_gain")).otherwise(fallback(GAIN))
    cost = F.when(F.col("estimated_cost") > 0, F.col("estimated_cost")).otherwise(fallback(COST))
    grouped = targets.groupBy(*keys, "strategy", "route_name").agg(
        F.count("*").alias("n_targets"), F.bround(F.sum(gain), 4).alias("expected_gain"), F.bround(F.sum(cost), 4).alias("estimated_cost"),
        S.risk_level(F.collect_set("risk")).alias("risk_level"), F.max("confidence").alias("confidence"), F.max("iteration").alias("iteration"), F.min("score_delta").alias("score_delta"),
    )
    gate = F.when((F.col("iteration") >= 1) & (F.col("estimated_cost") > 0) & (F.col("expected_gain") < 0.03), "expected_gain_below_cost_gate").when((F.col("risk_level") == "high") & (F.col("confidence") < 0.4), "low_confidence_high_risk_repair")
    rows = grouped.withColumn("priority", priority(F.col("strategy"), stalled(F.col("iteration"), F.col("score_delta")))).withColumn("skip_reason", gate).withColumn("verification_rule", verification_rule(F.col("strategy")))
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "route_name")))


METRICS = ["text_coverage", "normalized_similarity", "structure_retention", "table_preservation", "empty_block_penalty", "repetition_penalty", "total_score"]


def outcomes(actions: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Actions closed with score and metric deltas and the verdict of their rule."""
    b = before.select(*keys, F.struct(*METRICS).alias("b"))
    a = after.select(*keys, F.struct(*METRICS).alias("a"))
    rows = actions.join(b, keys).join(a, keys)
    delta = F.bround(F.col("a.total_score") - F.col("b.total_score"), 6)
    changed = F.struct(*(F.bround(F.col(f"a.{m}") - F.col(f"b.{m}"), 6).alias(m) for m in METRICS))
    rows = rows.withColumn("score_delta", delta).withColumn("changed", changed)
    passed = F.when(F.col("verification_rule") == "table_preservation_or_score_improves", (F.col("changed.table_preservation") > 0) | (F.col("score_delta") >= 0)).otherwise(F.col("score_delta") >= 0)
    return rows.withColumn("passed", passed).withColumn("failure_reason", F.when(~passed, "repair_did_not_improve_required_metric")).drop("a", "b")


def keep_best(rounds: DataFrame, keys: list[str], order: str = "round", score: str = "total_score") -> DataFrame:
    """Per round: the best score so far, whether it is a new best (ties favour newer), and whether the round is rolled back."""
    w = Window.partitionBy(*keys).orderBy(order)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = best.isNull() | (F.col(score) >= best)
    return rounds.withColumns({"previous_best": best, "is_best": new, "rolled_back": ~new, "best_score": F.greatest(F.coalesce(best, F.col(score)), F.col(score)), "score_delta": F.col(score) - F.lag(score).over(w)})


def fallback_chain(suffix: Column, media_type: Column) -> Column:
    """Parsers to try in order: by suffix, by media type, then the configured ones; each once."""
    from quillspark.sources import filetype as K

    return F.array_distinct(F.filter(F.array(K.base_parser(suffix, media_type), *(F.lit(p) for p in K.PDF_PARSERS)), lambda x: x.isNotNull()))


def needs_repair(iteration: Column, gate_failures: Column, n_table_issues: Column) -> Column:
    return (iteration < S.MAX_ROUNDS) & ((F.size(gate_failures) > 0) | (n_table_issues > 0))


def first_usable(candidates: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """The first candidate in order with content; failed checks are listed."""
    blank = T.blank(F.coalesce(F.col(content), F.lit("")))
    marker = F.forall(F.filter(T.lines(F.col(content)), lambda x: ~T.blank(x)), lambda x: T.strip(x).rlike(rf"{T.PAGE_MARKER}|^\[Table reference:.*\]$|^\[Image block omitted:.*\]$"))
    failures = F.filter(F.array(F.when(blank, F.lit("empty_content")), F.when(~blank & marker, F.lit("placeholder_only_content"))), lambda x: x.isNotNull())
    ranked = candidates.withColumn("failures", failures).withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy(F.size("failures") > 0, order)))
    return ranked.filter("pick = 1").drop("pick")
