"""The three end-to-end flows, as lazy compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.session import cut
from benchloom.functions.params import merge_layers, signature
from benchloom.operators import cases as C
from benchloom.operators import numbering as N
from benchloom.operators import realizations as RZ
from benchloom.operators import requests as RQ
from benchloom.operators import results as RS
from benchloom.operators import runs as RN
from benchloom.operators import summaries as SM
from benchloom.operators import themes as TH


def plan_requests(cases: DataFrame, targets: list[str] | DataFrame, task_id: str, selection: C.Selection | None = None) -> DataFrame:
    """Cases -> selected cases -> requests; filters run below the product."""
    chosen = C.sample_bundle(cases, selection).selected if selection else cases
    return RQ.expand_requests(chosen, targets, task_id)


def evaluate(
    cases: DataFrame,
    requests: DataFrame,
    responses: DataFrame,
    normalizers: list[RS.Normalizer],
    rules: list[RS.Rule],
    judge_replies: DataFrame | None = None,
    judge_scorer: str = "judge",
) -> dict[str, DataFrame]:
    """Responses -> results, normalized rows, scores, group analysis, summary and failures.

    Results, normalized rows and scores feed several layers, so each is written once to the
    shared folder.  Normalizers and rules that cannot run give failure rows.
    """
    results, silent = RQ.attach_responses(requests, responses)
    results = cut(results, "results")
    normalized = cut(RS.normalize_results(results, normalizers), "normalized")
    scores, bad_rules = RS.rule_scores(results, rules)
    failures = silent.select("stage", F.col("error")).unionByName(bad_rules.select("stage", "error")).unionByName(RS.normalizer_failures(results, normalizers).select("stage", "error"))
    if judge_replies is not None:
        judged, unparsed = RS.judge_scores(judge_replies, results, judge_scorer)
        scores = scores.unionByName(judged, allowMissingColumns=True)
        failures = failures.unionByName(unparsed.select("stage", F.col("error_message").alias("error")))
    scores = cut(scores, "scores")
    groups = SM.group_summary(results, scores)
    summary = SM.experiment_summary(results, normalized, scores, groups, None, failures)
    return {
        "cases": cases,
        "requests": requests,
        "target_results": results,
        "normalized_results": normalized,
        "score_records": scores,
        "group_analysis": groups,
        "summary": summary,
        "failures": failures,
    }


def build_cases(attempts: DataFrame, max_attempts: int) -> dict[str, DataFrame]:
    """Attempt table -> accepted, rejected, raw and retry tables with case statistics."""
    tables = RZ.accept_realizations(attempts, max_attempts)
    return tables


def build_theme_prompts(
    nodes: DataFrame, pools: dict[str, list[str]], counts: dict[str, int] | None = None, defaults: dict[str, int] | None = None,
    style: str = "detailed", seed: int = 42, dedupe: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Theme tree -> quotas -> draws -> drafts -> at most two rounds of regeneration."""
    plan = TH.theme_quota_plan(nodes, counts, defaults)
    TH.require_quota(plan)
    drafts = TH.compose_drafts(TH.draw_themes(nodes, plan, seed), pools, style, seed)
    return TH.dedupe_regenerate(drafts, pools, style, seed) if dedupe else (drafts, None)


def plan_tasks(prompts: DataFrame, run_defaults: dict[str, str], model: str, size: int) -> DataFrame:
    """Valid prompts (``parameters`` a text map, ``seq``) -> merged parameters -> batches."""
    defaults = F.create_map(*[F.lit(x) for kv in run_defaults.items() for x in kv]) if run_defaults else F.create_map().cast("map<string,string>")
    merged = prompts.withColumns({"model_name": F.lit(model), "params": merge_layers(defaults, F.col("parameters"))})
    return N.pack_batches(merged.withColumn("signature", signature(F.col("params"))), "model_name", "seq", "signature", size)


def finish_run(task_results: DataFrame, planned: DataFrame) -> dict[str, DataFrame]:
    """Task results -> dataset rows and ledger rows."""
    return {"dataset_records": RN.flatten_batches(task_results, planned), "ledger": RN.ledger_from_tasks(task_results, planned)}
