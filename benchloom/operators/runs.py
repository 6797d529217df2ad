"""Runs: ledgers, recovery, conditioning, rewrites, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom import fixed
from benchloom.functions.replies import json_text_value
from benchloom.functions.text import blank_to_null, slug
from benchloom.operators.keyed import first_wins, last_wins
from benchloom.operators.numbering import blockwise_row_number, number_records

KEY = ["model_name", "prompt_id"]


# --- U2, J6 ---------------------------------------------------------------------------
def key_outcomes(ledger: DataFrame, failed_tasks: DataFrame | None = None) -> DataFrame:
    """Per (model, prompt): 2 after any success, else 1 after any failure, in any order.

    Blank keys and other statuses are ignored.  ``failed_tasks`` holds (model_name,
    prompt_id) of every prompt of a failed task.
    """
    rank = F.when(F.col("status") == "success", 2).when(F.col("status") == "failed", 1)
    marks = ledger.select(*KEY, rank.alias("rank")).where(F.col("rank").isNotNull())
    if failed_tasks is not None:
        marks = marks.unionByName(failed_tasks.select(*KEY, F.lit(1).alias("rank")))
    filled = (F.coalesce(F.col("model_name"), F.lit("")) != "") & (F.coalesce(F.col("prompt_id"), F.lit("")) != "")
    return marks.where(filled).groupBy(*KEY).agg(F.max("rank").alias("rank"))


def failed_task_prompts(planned: DataFrame, failures: DataFrame) -> DataFrame:
    """Prompts planned in a task that failed; failures of unknown tasks drop out."""
    tasks = failures.where(F.coalesce("task_id", F.lit("")) != "").select("task_id").distinct()
    return planned.join(tasks, "task_id", "left_semi").select(*KEY)


def recovery_state(planned: DataFrame, ledger: DataFrame, failed_tasks: DataFrame | None = None) -> DataFrame:
    """Every known key with its state (success, failed, missing) and whether it is planned.

    Ledger keys outside the plan are listed too: they are counted, never emitted for work.
    """
    outcomes = key_outcomes(ledger, failed_tasks)
    keys = planned.groupBy(*KEY).agg(F.lit(True).alias("planned"))
    state = F.when(F.col("rank") == 2, "success").when(F.col("rank") == 1, "failed").otherwise("missing")
    return keys.join(outcomes, KEY, "full_outer").select(
        *KEY, state.alias("state"), F.coalesce("planned", F.lit(False)).alias("planned")
    )


def _planned_in_state(planned: DataFrame, ledger: DataFrame, failed_tasks: DataFrame | None, state: str, model: str | None) -> DataFrame:
    wanted = planned.where(F.col("model_name") == model) if model else planned
    outcomes = key_outcomes(ledger, failed_tasks)
    if state == "missing":
        return wanted.join(outcomes, KEY, "left_anti")
    return wanted.join(outcomes.where(F.col("rank") == 1), KEY, "left_semi")


def missing_items(planned: DataFrame, ledger: DataFrame, failed_tasks: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Resume: planned rows with neither a success nor a failure."""
    return _planned_in_state(planned, ledger, failed_tasks, "missing", model)


def failed_items(planned: DataFrame, ledger: DataFrame, failed_tasks: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Retry: planned rows that failed and never succeeded."""
    return _planned_in_state(planned, ledger, failed_tasks, "failed", model)


# --- J7, U3 ---------------------------------------------------------------------------
def unannotated(records: DataFrame, annotations: DataFrame, keys: list[str] = ("source_run_id", "source_record_id")) -> DataFrame:
    """Records without an annotation; run again after appending and nothing is left."""
    done = annotations.where(blank_to_null(keys[-1]).isNotNull()).select(*keys).distinct()
    return records.join(done, list(keys), "left_anti")


def append_annotations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union; ``batch`` keeps the existing rows in front when sorted."""
    return existing.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)), allowMissingColumns=True)


# --- J12, J13 -------------------------------------------------------------------------
ITEM = "array<struct<prompt_id:string,status:string,batch_index:bigint,error:string,artifacts:array<struct<type:string,path:string>>>>"


def flatten_batches(task_results: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per artifact of every successful batch item, with its planned prompt.

    ``task_results``: task_id, batch_items (see ``ITEM``); ``planned``: task_id, prompt_id, ….
    """
    items = task_results.select("task_id", F.posexplode("batch_items").alias("item_no", "i")).where("i.status = 'success'")
    artifacts = items.select(
        "task_id", "item_no", F.col("i.prompt_id").alias("prompt_id"), F.posexplode("i.artifacts").alias("artifact_no", "a")
    )
    flat = artifacts.select(
        "task_id", "prompt_id", "item_no", "artifact_no", F.col("a.type").alias("artifact_type"), F.col("a.path").alias("artifact_path"), F.lit("success").alias("status")
    )
    return flat.join(planned, ["task_id", "prompt_id"])


def ledger_from_tasks(task_results: DataFrame, planned: DataFrame) -> DataFrame:
    """One ledger row per batch item of a planned prompt.

    A task none of whose items is planned (or that has none) yields one failed row per
    planned prompt instead.
    """
    default_error = "Task failed before prompt-level outputs were available."
    plan = planned.select("task_id", "prompt_id", *[c for c in planned.columns if c not in ("task_id", "prompt_id", "error_message")])
    meta = task_results.select("task_id", *[c for c in ("error_message", "failure_category") if c in task_results.columns])
    has = lambda c: F.col(c) if c in meta.columns else F.lit(None).cast("string")
    items = task_results.select(*meta.columns, F.posexplode("batch_items").alias("item_no", "i"))
    ok = F.coalesce(F.col("i.status"), F.lit("failed")) == "success"
    rows = items.select(
        "task_id",
        F.col("i.prompt_id").alias("prompt_id"),
        F.coalesce("i.status", F.lit("failed")).alias("status"),
        F.get("i.artifacts", F.lit(0))["type"].alias("artifact_type"),
        F.get("i.artifacts", F.lit(0))["path"].alias("artifact_path"),
        F.greatest(F.coalesce(F.size("i.artifacts"), F.lit(0)), F.lit(0)).cast("bigint").alias("artifact_count"),
        F.when(~ok, F.coalesce(F.nullif(has("error_message"), F.lit("")), blank_to_null("i.error"))).alias("error_message"),
        F.when(~ok, has("failure_category")).alias("failure_category"),
        F.coalesce("i.batch_index", F.col("item_no").cast("bigint")).alias("batch_index"),
    ).join(plan, ["task_id", "prompt_id"])
    usable = rows.select("task_id").distinct()
    dead = meta.join(usable, "task_id", "left_anti")
    failed = plan.join(dead, "task_id").select(
        "task_id",
        "prompt_id",
        F.lit("failed").alias("status"),
        F.lit(None).cast("string").alias("artifact_type"),
        F.lit(None).cast("string").alias("artifact_path"),
        F.lit(0).cast("bigint").alias("artifact_count"),
        F.coalesce(F.nullif(has("error_message"), F.lit("")), F.lit(default_error)).alias("error_message"),
        has("failure_category").alias("failure_category"),
        F.lit(None).cast("bigint").alias("batch_index"),
        *[c for c in plan.columns if c not in ("task_id", "prompt_id")],
    )
    return rows.unionByName(failed)


# --- J9, J10 --------------------------------------------------------------------------
def conditioning_artifacts(items: DataFrame) -> DataFrame:
    """Generated artifact per (target, prompt, type): first artifact of the last successful item.

    ``items``: target_model, prompt_id, conditioning_type, status, seq, artifacts.
    """
    path = blank_to_null(F.get("artifacts", F.lit(0))["path"])
    usable = items.where((F.col("status") == "success") & path.isNotNull()).select(
        "target_model", "prompt_id", F.coalesce(blank_to_null("conditioning_type"), F.lit("image")).alias("conditioning_type"), path.alias("path"), "seq"
    )
    return last_wins(usable, ["target_model", "prompt_id", "conditioning_type"], ["seq"]).drop("seq")


def bind_conditioning(
    prompts: DataFrame, artifacts: DataFrame, conditioning_type: str = "image", aliases: tuple[str, ...] = ("ref_path", "image_path")
) -> tuple[DataFrame, DataFrame]:
    """(bound, unbound): the prompt's own path, else the generated artifact.

    Bound rows get the path, its source label and an artifact id.
    """
    provided = F.coalesce(*[F.nullif(F.col(a), F.lit("")) for a in aliases if a in prompts.columns])
    side = artifacts.where(F.col("conditioning_type") == conditioning_type).select("target_model", "prompt_id", F.col("path").alias("__generated"))
    joined = prompts.withColumn("__provided", provided).join(side, ["target_model", "prompt_id"], "left")
    stage = F.when(F.col("__provided").isNotNull(), "prompt_provided").otherwise("conditioning_preparation")
    bound = joined.withColumns(
        {
            "conditioning_path": F.coalesce("__provided", "__generated"),
            "conditioning_source": F.when(F.col("__provided").isNotNull(), "provided").otherwise("generated"),
            "conditioning_artifact_id": F.concat_ws("_", stage, slug("target_model"), F.lit(conditioning_type), "prompt_id"),
        }
    ).drop("__provided", "__generated")
    ok = F.col("conditioning_path").isNotNull()
    missing = bound.where(~ok).drop("conditioning_path", "conditioning_source", "conditioning_artifact_id")
    return bound.where(ok), missing.withColumn("error", F.lit(f"no {conditioning_type} conditioning artifact"))


def apply_rewrites(prompts: DataFrame, rewrites: DataFrame, stage_order: int = 1) -> DataFrame:
    """Prompts with their rewrite, or the original with a reason; a history entry either way.

    ``rewrites``: target_model, prompt_id, status, raw_reply (null when the artifact is
    missing), seq.  Of several replies to one prompt the last wins.
    """
    keys = ["target_model", "prompt_id"]
    last = last_wins(rewrites.select(*keys, "status", "raw_reply", "seq"), keys, ["seq"])
    text = F.nullif(json_text_value("raw_reply", fixed.REWRITE_TEXT_KEYS), F.lit(""))
    side = last.select(
        *keys,
        F.when(F.col("status") == "success", text).alias("__new"),
        F.when(F.coalesce(F.col("status"), F.lit("")) != "success", "batch item status failed")
        .when(F.col("raw_reply").isNull(), "rewrite output artifacts missing")
        .when(text.isNull(), "rewrite response empty")
        .alias("__why"),
        F.lit(True).alias("__seen"),
    )
    joined = prompts.join(side, keys, "left")
    hit = F.col("__new").isNotNull()
    why = F.when(F.col("__seen").isNull(), "rewrite output missing").otherwise(F.col("__why"))
    entry = F.struct(
        F.when(hit, "rewritten").otherwise("fallback_original").alias("status"),
        F.col("prompt").alias("original_prompt"),
        F.lit(stage_order).alias("stage_order"),
        F.when(~hit, why).alias("error"),
    )
    history = F.array_append("prompt_rewrite_history", entry) if "prompt_rewrite_history" in prompts.columns else F.array(entry)
    return joined.withColumns(
        {
            "rewrite_status": entry["status"],
            "rewrite_error": entry["error"],
            "prompt_rewrite_history": history,
            "prompt": F.coalesce("__new", "prompt"),
        }
    ).drop("__new", "__why", "__seen")


def rewrite_summary(rewritten: DataFrame) -> DataFrame:
    """Rewritten and fallback counts per target."""
    n = lambda s: F.count_if(F.col("rewrite_status") == s)
    return rewritten.groupBy("target_model").agg(n("rewritten").alias("rewritten"), n("fallback_original").alias("fallback_original"))


# --- U1 -------------------------------------------------------------------------------
def union_runs(dfs: list[DataFrame]) -> DataFrame:
    """All runs' records with ``run_order``; columns a run lacks are null."""
    if not dfs:
        raise ValueError("at least one run is required")
    tagged = [df.withColumn("run_order", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_runs(dfs: list[DataFrame] | DataFrame, manifests: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Union of several runs with their lineage, renumbered densely in run order.

    By default the records of a run follow the number in their id, ids without one the others.
    """
    merged = union_runs(dfs) if isinstance(dfs, list) else dfs
    if order is None:
        number = F.regexp_extract("record_id", r"(\d+)$", 1)
        merged = merged.withColumn("__number", F.when(number != "", number.try_cast("decimal(38,0)")))
        merged = merged.withColumn("__unnumbered", F.col("__number").isNull())
        order = ["run_order", "__unnumbered", "__number", "record_id"]
    return number_records(merged.join(_lineage(manifests), "run_id", "left"), list(order)).drop("__number", "__unnumbered")


def _lineage(manifests: DataFrame) -> DataFrame:
    return first_wins(
        manifests.select("run_id", "parent_run_id", "source_run_id", "recovery_mode"), ["run_id"], ["parent_run_id"]
    ).select("run_id", F.struct("parent_run_id", "source_run_id", "recovery_mode").alias("source_run_lineage"))


# --- W10 ------------------------------------------------------------------------------
def resolve_policy(continue_on_error: bool | None, max_failures: int | None, max_rate: float | None) -> bool:
    """Whether a run goes on after a failure: setting a limit implies it."""
    if max_failures is not None and max_failures < 0:
        raise ValueError("max_failures must be >= 0")
    if max_rate is not None and not 0.0 <= max_rate <= 1.0:
        raise ValueError("max_rate must be between 0 and 1")
    if continue_on_error is None:
        return max_failures is not None or max_rate is not None
    return continue_on_error


def breach_rank(planned_total: Column, max_failures: int | None, max_rate: float | None) -> Column:
    """Number of the failure that breaches a limit (strictly greater), null when none can."""
    by_count = F.lit(None if max_failures is None else max_failures + 1).cast("bigint")
    if max_rate is None:
        return by_count
    p = planned_total.cast("double")
    guess = F.floor(p * F.lit(max_rate))
    # One correction step each way keeps the cut exact under floating point.
    exact = F.when((guess + 0) / p > max_rate, guess).when((guess + 1) / p > max_rate, guess + 1).otherwise(guess + 2)
    by_rate = F.when(p > 0, F.greatest(exact, F.lit(1)).cast("bigint"))
    return F.least(by_count, by_rate) if max_failures is not None else by_rate


def failure_budget(
    ledger: DataFrame, planned: DataFrame, max_failures: int | None = None, max_rate: float | None = None, block_seconds: int = 3600
) -> DataFrame:
    """First breaching row per run with the failures and the rate at that point.

    ``planned``: run_id, planned_total; a run without a plan counts as 0 planned, so only the
    count limit holds for it.  Only failed rows are numbered, per run and time block, so a run
    with most of the rows is spread over its blocks.
    """
    failed = ledger.where(F.col("status") == "failed").select("run_id", "ts", "event_id")
    block = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(block_seconds * 1_000_000))
    numbered = blockwise_row_number(failed, ["run_id"], ["ts", "event_id"], block, "failed_outputs")
    known = numbered.join(planned.select("run_id", "planned_total"), "run_id", "left").withColumn("planned_total", F.coalesce("planned_total", F.lit(0)))
    hit = known.where(F.col("failed_outputs") == breach_rank(F.col("planned_total"), max_failures, max_rate))
    rate = F.when(F.col("planned_total") > 0, F.col("failed_outputs") / F.col("planned_total")).otherwise(0.0)
    return hit.select("run_id", "ts", "event_id", "failed_outputs", rate.alias("failure_rate"))


def rows_within_budget(ledger: DataFrame, breaches: DataFrame) -> DataFrame:
    """Ledger rows up to and including the breach of their run; all rows of other runs."""
    cut = breaches.select("run_id", F.struct("ts", "event_id").alias("__cut"))
    joined = ledger.join(cut, "run_id", "left")
    return joined.where(F.col("__cut").isNull() | (F.struct("ts", "event_id") <= F.col("__cut"))).drop("__cut")
