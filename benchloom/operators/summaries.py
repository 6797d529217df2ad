"""Group summaries, experiment summaries and count tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom.functions import variants as V
from benchloom.functions.failures import categorize_failure
from benchloom.operators.keyed import last_wins


def _counts(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One (metric, key, n) row per value of each key, in a single pass.

    Every row becomes one (metric, value) pair per key; pairs are counted before the
    shuffle, so only the distinct pairs of each task move.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), k.cast("string").alias("key")) for m, k in keys.items()])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.metric", "p.key").agg(F.count("*").alias("n"))


def _or(c: Column | str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(default))


# --- A1 -------------------------------------------------------------------------------
MOST_NAMES = 1000  # labels, and score names, in the maps of a group


def group_facts(results: DataFrame, scores: DataFrame, on: str = "case_id") -> DataFrame:
    """Long-form facts per (target, split, group, scorer): kind is ``row``, ``label`` or ``score``.

    A score matches every result of its target and case, so k results count it k times.
    Both sides are folded first -- results to a multiplicity per case, scores to counts and
    sums per case -- and the multiplicity becomes a factor: the fan-out itself is never built.
    """
    group = ["target_model", "split", "group_key"]
    times = results.groupBy(*group, on).agg(F.count("*").alias("k"))
    entry = lambda kind, name, value: F.struct(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("double").alias("value")
    )
    parts = [F.array(entry("row", F.lit(None), F.lit(None)))]
    if "labels" in scores.columns:
        parts.append(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: entry("label", x, F.lit(None))))
    parts.append(
        F.transform(
            F.map_entries(F.coalesce("scores", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))),
            lambda e: entry("score", e["key"], e["value"]),
        )
    )
    folded = (
        scores.select("target_model", on, "scorer_id", F.explode(F.concat(*parts)).alias("e"))
        .groupBy("target_model", on, "scorer_id", "e.kind", "e.name")
        .agg(F.count("*").alias("n"), F.sum("e.value").alias("s"))
    )
    return (
        times.join(folded, ["target_model", on])
        .groupBy(*group, "scorer_id", "kind", "name")
        .agg(F.sum(F.col("n") * F.col("k")).alias("n"), F.sum(F.col("s") * F.col("k")).alias("total"))
    )


def group_labels(results: DataFrame, scores: DataFrame, on: str = "case_id") -> DataFrame:
    """One row per target, split, group, scorer and label: how many score rows of the group carry it.  Exact, whatever the number of labels."""
    facts = group_facts(results, scores, on).where(F.col("kind") == "label")
    return facts.select("target_model", "split", "group_key", "scorer_id", F.col("name").alias("label"), F.col("n").cast("bigint").alias("n"))


def _most_frequent(facts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of the facts per ``keys`` the ``most`` with the highest count, ties by name, with ``names``, how many there are in all.

    They are cut per salt first, so a group of very many names is many tasks' work.
    """
    order = [F.desc("n"), F.asc("name")]
    salt, whole = W.partitionBy(*keys, "__salt"), W.partitionBy(*keys)
    cut_once = facts.withColumn("__salt", F.pmod(F.xxhash64("name"), F.lit(64)))
    cut_once = cut_once.withColumns({"__r": F.row_number().over(salt.orderBy(*order)), "__m": F.count("*").over(salt)}).where(F.col("__r") <= most)
    ranked = cut_once.withColumns({"names": F.sum(F.when(F.col("__r") == 1, F.col("__m"))).over(whole), "__place": F.row_number().over(whole.orderBy(*order))})
    return ranked.where(F.col("__place") <= most).drop("__r", "__m", "__salt", "__place")


def group_summary(results: DataFrame, scores: DataFrame, on: str = "case_id", most_names: int = MOST_NAMES) -> DataFrame:
    """By target, split, group and scorer: case count, score rows, labels, label counts, mean scores.

    A group without scores is one row with a null scorer and zero score rows.  The maps hold the
    ``most_names`` most frequent labels and score names, so no row grows with their number;
    ``n_labels`` counts all labels, and ``group_labels`` gives the count of every one.
    """
    group = ["target_model", "split", "group_key"]
    keys = [*group, "scorer_id", "kind"]
    sizes = results.groupBy(*group).agg(F.count("*").alias("case_count"))
    facts = group_facts(results, scores, on)
    pick = lambda kind, value: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("name").alias("k"), value.alias("v")))))
    )
    rows = _most_frequent(facts, keys, most_names).groupBy(*group, "scorer_id").agg(
        F.sum(F.when(F.col("kind") == "row", F.col("n"))).alias("score_record_count"),
        pick("label", F.col("n")).alias("label_counts"),
        pick("score", F.col("total") / F.col("n")).alias("scores"),
        F.max(F.when(F.col("kind") == "label", F.col("names"))).alias("n_labels"),
    )
    return (
        sizes.join(rows, group, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("score_record_count", "n_labels")})
        .withColumn("labels", F.coalesce(F.map_keys("label_counts"), F.array().cast("array<string>")))
    )


# --- A2 -------------------------------------------------------------------------------
def experiment_summary(
    results: DataFrame,
    normalized: DataFrame | None = None,
    scores: DataFrame | None = None,
    analyses: DataFrame | None = None,
    plugins: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """Long-form (metric, key, subkey, value) summary of one experiment; absent layers count zero."""
    nothing = F.lit(None).cast("string")

    def shape(df: DataFrame, metric, key=nothing, subkey=nothing, value=F.col("n")) -> DataFrame:
        metric = F.lit(metric) if isinstance(metric, str) else metric
        return df.select(metric.alias("metric"), key.alias("key"), subkey.alias("subkey"), value.cast("double").alias("value"))

    per_case = results.groupBy("case_id").agg(F.count("*").alias("n"))
    totals = {"target_result_count": F.lit(None), "counts_by_target_model": F.col("target_model"), "counts_by_split": F.col("split")}
    out = [
        shape(per_case.agg(F.count("*").alias("n")), "case_count"),
        shape(_counts(results, totals), F.col("metric"), F.col("key")),
    ]
    layers = {
        "normalized_result_count": (normalized, "normalizer_id", "counts_by_normalizer"),
        "group_analysis_record_count": (analyses, None, None),
        "analysis_plugin_result_count": (plugins, "plugin_id", "counts_by_analysis_plugin"),
        "failure_count": (failures, None, None),
    }
    for metric, (df, key, by) in layers.items():
        pairs = {metric: F.lit(None)}
        if df is not None and key in df.columns:
            pairs[by] = F.col(key)
        out.append(_or_zero(shape, results, df, metric, pairs))
    out.append(_score_metrics(shape, results, scores))
    return reduce(DataFrame.unionByName, out)


def _or_zero(shape, results: DataFrame, df: DataFrame | None, metric: str, pairs: dict[str, Column]) -> DataFrame:
    """Counts of a layer; an absent or empty one still states its zero total."""
    zero = results.sparkSession.range(1).select(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("n"))
    if df is None:
        return shape(zero, metric)
    both = _counts(df, pairs).unionByName(zero).groupBy("metric", "key").agg(F.sum("n").alias("n"))
    return shape(both, F.col("metric"), F.col("key"))


def _score_metrics(shape, results: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Totals, counts by scorer, label counts and mean scores in one pass over the scores."""
    if scores is None:
        return _or_zero(shape, results, None, "score_record_count", {})
    fact = lambda metric, key, sub, value: F.struct(
        F.lit(metric).alias("metric"), key.cast("string").alias("key"), sub.cast("string").alias("subkey"), value.cast("double").alias("v")
    )
    none = F.lit(None)
    parts = [F.array(fact("score_record_count", none, none, none), fact("counts_by_scorer", F.col("scorer_id"), none, none))]
    if "labels" in scores.columns:
        parts.append(F.transform("labels", lambda x: fact("label_counts_by_target_model", F.col("target_model"), x, none)))
    parts.append(F.transform(F.map_entries("scores"), lambda e: fact("average_numeric_score", F.col("scorer_id"), e["key"], e["value"])))
    filled = [F.coalesce(p, F.array().cast("array<struct<metric:string,key:string,subkey:string,v:double>>")) for p in parts]
    facts = scores.select(F.explode(F.concat(*filled)).alias("f")).groupBy("f.metric", "f.key", "f.subkey").agg(F.count("*").alias("n"), F.avg("f.v").alias("mean"))
    value = F.when(F.col("metric") == "average_numeric_score", F.col("mean")).otherwise(F.col("n"))
    counted = facts.where((F.col("metric") != "average_numeric_score") | F.col("mean").isNotNull())
    rows = shape(counted, F.col("metric"), F.col("key"), F.col("subkey"), value)
    # An empty layer still states its zero total.
    zero = _or_zero(shape, results, None, "score_record_count", {})
    return rows.unionByName(zero).groupBy("metric", "key", "subkey").agg(F.sum("value").alias("value"))


# --- A3 to A8 -------------------------------------------------------------------------
def case_stats(cases: DataFrame, family: Column | None = None) -> DataFrame:
    """Counts by modality, split, builder and family as (metric, key, n)."""
    if family is None:
        from benchloom.functions.groups import truthy_text

        family = F.coalesce(truthy_text("metadata", "family_id"), truthy_text("metadata", "template_id"))
    return _counts(
        cases,
        {
            "input_type": F.col("input_modality"),
            "split": F.col("split"),
            "builder": _or("source_builder", "unknown"),
            "family": _or(family, "unspecified"),
        },
    )


def prompt_stats(prompts: DataFrame) -> DataFrame:
    """Counts by category, subcategory and theme; a missing value counts as empty text."""
    return _counts(prompts, {k: F.coalesce(F.col(k), F.lit("")) for k in ("category", "subcategory", "theme")})


def annotation_stats(annotations: DataFrame, failures: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts by artifact type, source model and annotator, and the three totals."""
    by = _counts(
        annotations,
        {
            "artifact_type": F.coalesce("source_artifact_type", F.lit("")),
            "source_model": F.coalesce("source_model_name", F.lit("")),
            "annotator_model": F.coalesce("annotator_model", F.lit("")),
        },
    )
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(
        F.lit(name).alias("metric"), F.lit(None).cast("string").alias("key"), "n"
    )
    return (
        by.unionByName(total(annotations, "annotation_count"))
        .unionByName(total(failures, "failed_count"))
        .unionByName(total(skipped, "skipped_count"))
    )


def sample_plan_stats(samples: DataFrame) -> DataFrame:
    """Sample and resample counts by category, first two levels and full path, and in total."""
    prefix = lambda n: F.concat_ws(" / ", F.slice("theme_path", 1, n) if n else F.col("theme_path"))
    leveled = samples.select(
        F.get("theme_path", F.lit(0)).alias("category"), prefix(2).alias("subcategory"), prefix(0).alias("theme"), "resampled"
    )
    rolled = leveled.rollup("category", "subcategory", "theme").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("resampled").alias("n_resampled")
    )
    level = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "category").when(F.col("g") == 1, "subcategory").otherwise("theme")
    key = F.when(F.col("g") == 3, F.col("category")).when(F.col("g") == 1, F.col("subcategory")).when(F.col("g") == 0, F.col("theme"))
    return rolled.select(level.alias("level"), key.alias("key"), "n", "n_resampled")


def export_stats(df: DataFrame) -> DataFrame:
    """Counts of exported records by model, split, artifact type and run; blank is ``unknown``."""
    exported = df.where(F.col("disposition") == "exported") if "disposition" in df.columns else df
    return _counts(exported, {k: _or(k, "unknown") for k in ("model_name", "split", "artifact_type", "run_id")})


def source_run_stats(df: DataFrame) -> DataFrame:
    """Exported, skipped and filtered counts per run, from ``disposition``."""
    n = lambda d: F.count_if(F.col("disposition") == d)
    return df.groupBy("run_id").agg(n("exported").alias("exported"), n("skipped").alias("skipped"), n("filtered").alias("filtered"))


def replica_summary(planned: DataFrame, task_results: DataFrame) -> DataFrame:
    """Planned and actual task counts per model and replica; a replica on either side is listed."""
    p = planned.groupBy("model_name", "replica_id").agg(F.count_distinct("task_id").alias("planned_task_count"))
    a = task_results.where(F.col("replica_id").isNotNull()).groupBy("model_name", "replica_id").agg(F.count_distinct("task_id").alias("task_count"))
    return p.join(a, ["model_name", "replica_id"], "full_outer").select(
        "model_name",
        "replica_id",
        F.coalesce("planned_task_count", F.lit(0)).cast("bigint").alias("planned_task_count"),
        F.coalesce("task_count", F.lit(0)).cast("bigint").alias("task_count"),
    )


def run_model_summary(planned: DataFrame, task_results: DataFrame, records: DataFrame) -> DataFrame:
    """Per model: record count, task count and its replicas as an array of structs."""
    rec = records.groupBy("model_name").agg(F.count("*").alias("record_count"))
    tasks = task_results.groupBy("model_name").agg(F.count_distinct("task_id").alias("task_count"))
    replicas = replica_summary(planned, task_results).groupBy("model_name").agg(
        F.array_sort(F.collect_list(F.struct("replica_id", "planned_task_count", "task_count"))).alias("replicas")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (
        rec.join(tasks, "model_name", "full_outer")
        .join(replicas, "model_name", "full_outer")
        .select("model_name", zero("record_count"), zero("task_count"), "replicas")
    )


# --- A9 to A11 ------------------------------------------------------------------------
def _decisions(results: DataFrame, normalized: DataFrame) -> DataFrame:
    keys = ["target_model", "source_run_id", "source_record_id"]
    last = last_wins(normalized.select(*keys, "normalizer_id", "decision_text"), keys, ["normalizer_id"])
    return results.join(last.drop("normalizer_id"), keys)


def family_consistency(results: DataFrame, normalized: DataFrame, scores: DataFrame) -> DataFrame:
    """Long form per (target, split, family): ``cases``, ``action`` and ``label`` counts."""
    group = ["target_model", "split", "family_id"]
    cases = results.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.lit("cases").alias("kind"), F.lit("").alias("name"), "n")
    decided = _decisions(results, normalized).where(F.coalesce("decision_text", F.lit("")) != "")
    actions = decided.groupBy(*group, F.col("decision_text").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("action"))
    return cases.unionByName(actions).unionByName(_label_counts(results, scores, group))


def _label_counts(results: DataFrame, scores: DataFrame, group: list[str]) -> DataFrame:
    times = results.groupBy(*group, "case_id").agg(F.count("*").alias("k"))
    labels = scores.select("target_model", "case_id", F.explode("labels").alias("name")).groupBy("target_model", "case_id", "name").agg(F.count("*").alias("n"))
    return (
        times.join(labels, ["target_model", "case_id"])
        .groupBy(*group, "name")
        .agg(F.sum(F.col("n") * F.col("k")).alias("n"))
        .select(*group, F.lit("label").alias("kind"), "name", "n")
    )


def family_action_counts(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Like ``family_consistency``, with actions taken from the judge's ``recommended_action``."""
    group = ["target_model", "split", "family_id"]
    cases = results.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.lit("cases").alias("kind"), F.lit("").alias("name"), "n")
    action = F.nullif(V.get_text("raw_judgment", "recommended_action"), F.lit(""))
    times = results.groupBy(*group, "case_id").agg(F.count("*").alias("k"))
    acts = scores.select("target_model", "case_id", action.alias("name")).where("name is not null").groupBy("target_model", "case_id", "name").agg(F.count("*").alias("n"))
    actions = (
        times.join(acts, ["target_model", "case_id"])
        .groupBy(*group, "name")
        .agg(F.sum(F.col("n") * F.col("k")).alias("n"))
        .select(*group, F.lit("action").alias("kind"), "name", "n")
    )
    return cases.unionByName(actions).unionByName(_label_counts(results, scores, group))


def slot_sensitivity(results: DataFrame, normalized: DataFrame) -> DataFrame:
    """By target, split, slot and value: counts per decision and the number of distinct decisions.

    ``slot_assignments`` is a map of text; rows without a decision are left out.
    """
    key = ["target_model", "split", "slot_id", "slot_value"]
    decided = _decisions(results, normalized).where(F.coalesce("decision_text", F.lit("")) != "")
    slots = decided.select("target_model", "split", F.explode("slot_assignments").alias("slot_id", "slot_value"), "decision_text")
    counts = slots.groupBy(*key, "decision_text").agg(F.count("*").alias("n"))
    distinct = counts.groupBy(*key).agg(F.count("*").alias("distinct_decisions"))
    return counts.join(distinct, key)


# --- A12 ------------------------------------------------------------------------------
def failure_rollup(ledger: DataFrame, message: str = "error_message") -> DataFrame:
    """Failures per run, model and category with subtotals; nulls mark a subtotal."""
    failed = ledger.where(F.col("status") == "failed").select("run_id", "model_name", categorize_failure(message).alias("category"))
    return failed.rollup("run_id", "model_name", "category").agg(F.count("*").alias("n"))
