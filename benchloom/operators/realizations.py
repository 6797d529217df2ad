"""Slot matrices, realization replies, verdicts and the attempt loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom import fixed
from benchloom.functions import variants as V
from benchloom.functions.guards import normalized_options
from benchloom.functions.replies import json_payload
from benchloom.functions.seeded import draw_unit
from benchloom.functions.text import blank_to_null, digits, normalize_text, strip_ws

LAYERS = ("structural", "narrative", "perturbation")
VARIANT_CHUNK = 10_000


# --- J15 ------------------------------------------------------------------------------
def slots_for_templates(templates: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template slots with their definition, references to unknown slots).

    ``templates``: template_id, used_slots array<struct<layer,slot_id>>.
    """
    refs = templates.select("template_id", F.posexplode("used_slots").alias("position", "u")).select(
        "template_id", "position", F.col("u.layer").alias("layer"), blank_to_null("u.slot_id").alias("slot_id")
    )
    refs = refs.where(F.col("slot_id").isNotNull())
    known = slots.withColumn("__known", F.lit(True))
    joined = refs.join(known, "slot_id", "left")
    bad = joined.where(F.col("__known").isNull()).select("template_id", "layer", "slot_id", F.lit("unknown slot").alias("error"))
    return joined.where(F.col("__known")).drop("__known"), bad


# --- G3 -------------------------------------------------------------------------------
def slot_matrix(templates: DataFrame, slots: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(case_id, template_id, variant, layer, slot_id, slot_value), n variants per template.

    Enum and boolean slots cycle through their values, integer ranges through their span,
    float ranges draw by hash.  ``slots``: slot_id, kind, values array<string>, min, max.
    """
    resolved, _ = slots_for_templates(templates, slots)
    i = F.col("variant")
    values = F.when(
        (F.col("kind") == "boolean") & (F.coalesce(F.size("values"), F.lit(0)) <= 0), F.array(F.lit("False"), F.lit("True"))
    ).otherwise(F.col("values"))
    lo, hi = F.coalesce("min", F.lit(0.0)), F.coalesce("max", "min", F.lit(0.0))
    cycle = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.get(values, F.pmod(i, F.size(values)).cast("int")))
    span = hi.cast("bigint") - lo.cast("bigint") + 1
    whole = (lo.cast("bigint") + F.pmod(i, span)).cast("string")
    real = (lo + draw_unit(seed, "template_id", "slot_id", i.cast("string")) * (hi - lo)).cast("string")
    value = (
        F.when(F.col("kind").isin("enum", "boolean"), cycle).when(F.col("kind") == "integer_range", whole).when(F.col("kind") == "float_range", real)
    )
    chunk = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // VARIANT_CHUNK))).alias("chunk")
    spread = resolved.select("*", chunk)
    first = F.col("chunk") * VARIANT_CHUNK
    rows = spread.select("*", F.explode(F.sequence(first, F.least(first + VARIANT_CHUNK, F.lit(n)) - 1)).alias("variant"))
    return rows.select(
        F.concat(F.col("template_id"), F.lit("_"), digits(i + 1, 3)).alias("case_id"), "template_id", i.cast("bigint").alias("variant"), "layer", "slot_id", value.alias("slot_value")
    )


def slot_assignments(matrix: DataFrame) -> DataFrame:
    """One row per case with its assignments and layers as maps (a template has few slots)."""
    return matrix.groupBy("case_id", "template_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot_id", "slot_value")))).alias("slot_assignments"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot_id", "layer")))).alias("slot_layers"),
    )


# --- T18 ------------------------------------------------------------------------------
def parse_realizations(replies: DataFrame, reply: str = "raw_reply") -> DataFrame:
    """Adds scene_text, decision_frame (VARIANT), action_structure, has_frame and decision_options."""
    staged = replies.withColumn("__payload", json_payload(reply))
    keys = [strip_ws(F.nullif(V.get_text("__payload", k), F.lit(""))) for k in fixed.REALIZATION_TEXT_KEYS]
    frame = V.get("__payload", "decision_frame")
    is_frame = V.kind(frame).startswith("OBJECT") & (F.to_json(frame) != "{}")
    raw_options = V.get("__payload", "decision_options")
    items = F.when(V.kind(raw_options).startswith("ARRAY"), F.try_variant_get(raw_options, "$", "array<variant>"))
    none = F.array().cast("array<struct<id:string,text:string>>")
    return staged.select(
        *replies.columns,
        F.coalesce(*keys, strip_ws(F.coalesce(F.col(reply), F.lit("")))).alias("scene_text"),
        F.when(is_frame, frame).alias("decision_frame"),
        F.coalesce(strip_ws(V.get_text(frame, "action_structure")), F.lit("")).alias("action_structure"),
        F.coalesce(is_frame, F.lit(False)).alias("has_frame"),
        F.coalesce(normalized_options(items), none).alias("decision_options"),
    )


# --- T20 ------------------------------------------------------------------------------
def parse_verdicts(replies: DataFrame, reply: str = "raw_reply") -> DataFrame:
    """Adds valid, issues and feedback arrays of a validator reply.

    Empty and non-JSON replies become fixed issues; a valid verdict has none; feedback
    falls back to the issues; blank entries are dropped.
    """
    none = F.array().cast("array<string>")
    solid = lambda a: F.filter(a, lambda x: blank_to_null(x).isNotNull())
    staged = replies.withColumn("__payload", json_payload(reply))
    flag = V.get("__payload", "valid")
    truthy = (
        F.when(V.kind(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean"))
        .when(V.kind(flag).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(flag, "$", "double") != 0)
        .when(V.kind(flag) == "VOID", F.lit(False))
        .otherwise(~V.as_text(flag).isin("", "[]", "{}"))
    )
    valid = F.coalesce(truthy, F.lit(False))
    listed = F.coalesce(solid(V.text_list(V.get("__payload", "issues"))), none)
    issues = (
        F.when(blank_to_null(reply).isNull(), F.array(F.lit(fixed.GUARD_MESSAGES["verdict_empty"])))
        .when(F.col("__payload").isNull(), F.array(F.lit(fixed.GUARD_MESSAGES["verdict_text"])))
        .when(valid, none)
        .otherwise(listed)
    )
    feedback = F.coalesce(solid(V.text_list(V.get("__payload", "feedback_for_retry"))), issues)
    return staged.withColumns({"valid": valid, "issues": issues}).withColumn("feedback", feedback).drop("__payload")


# --- G6 -------------------------------------------------------------------------------
def accept_realizations(attempts: DataFrame, max_attempts: int) -> dict[str, DataFrame]:
    """Accepted, rejected, raw and retry tables of the attempt loop.

    ``attempts``: case_id, attempt, error arrays ``synthesis_errors``, ``guard_errors``,
    ``verdict_issues``, ``verdict_feedback`` and the realization columns.  Per case the
    first attempt without errors wins, else the last allowed one.
    """
    none = F.array().cast("array<string>")
    fill = lambda c: F.coalesce(F.col(c), none)
    errors = F.array_distinct(F.concat(fill("synthesis_errors"), fill("guard_errors"), fill("verdict_issues")))
    rows = attempts.where(F.col("attempt") <= max_attempts).withColumn("errors", errors)
    clean = F.size("errors") == 0
    body = [c for c in rows.columns if c != "case_id"]
    settled = rows.groupBy("case_id").agg(
        F.min_by(F.struct(*body), F.when(clean, F.col("attempt"))).alias("good"), F.max_by(F.struct(*body), F.col("attempt")).alias("last")
    )
    final = settled.select("case_id", F.coalesce("good", "last").alias("r")).select("case_id", *[F.col("r")[c].alias(c) for c in body])
    valid = F.size("errors") == 0
    raw = final.withColumn("valid", valid)
    open_cases = raw.where(~F.col("valid") & (F.col("attempt") < max_attempts))
    feedback = F.when(F.size(fill("verdict_feedback")) > 0, F.col("verdict_feedback")).otherwise(F.col("errors"))
    retry = open_cases.select("case_id", (F.col("attempt") + 1).alias("next_attempt"), F.array_distinct(feedback).alias("feedback"))
    return {
        "accepted": raw.where("valid"),
        "rejected": raw.where(~F.col("valid") & (F.col("attempt") >= max_attempts)),
        "raw": raw,
        "retry": retry,
    }


# --- T21 ------------------------------------------------------------------------------
def prompts_from_replies(replies: DataFrame, samples: DataFrame | None = None, reply: str = "raw_reply") -> DataFrame:
    """Generation replies as prompts with their sample's provenance.

    JSON ``prompt``, else the whole text, else a default sentence; reply tags count only
    when they are a list, otherwise the sample's tags are used.  The provenance is that of the
    sample with the reply's ``sample_id``, which ``samples`` must hold once.  Without ``samples``
    the replies carry it, and all their other columns stay: one row a reply, whatever its id.
    """
    text = normalize_text(F.coalesce(F.col(reply), F.lit("")))
    staged = replies.withColumns({"__payload": json_payload(reply), "__text": text})
    own = F.nullif(normalize_text(F.coalesce(V.get_text("__payload", "prompt"), F.lit(""))), F.lit(""))
    prompt = (
        F.when(F.col("__payload").isNotNull(), F.coalesce(own, F.lit(fixed.PAYLOAD_DEFAULT_PROMPT)))
        .when(F.col("__text") == "", F.lit(fixed.REPLY_DEFAULT_PROMPT))
        .otherwise(F.col("__text"))
    )
    negative = F.nullif(normalize_text(F.coalesce(V.get_text("__payload", "negative_prompt"), F.lit(""))), F.lit(""))
    carried = [] if samples is not None else [c for c in replies.columns if c not in ("sample_id", reply)]
    parsed = staged.select(
        "sample_id", prompt.alias("prompt"), negative.alias("negative_prompt"), V.text_list(V.get("__payload", "tags")).alias("__tags"), *carried
    )
    if samples is None:
        keep, joined = carried, parsed
    else:
        keep = [c for c in ("seq", "category", "subcategory", "subtopic", "theme", "theme_path", "resampled", "tags", "metadata") if c in samples.columns]
        joined = parsed.join(samples.select("sample_id", *keep), "sample_id", "left")
    if "tags" in keep:
        joined = joined.withColumn("tags", F.coalesce("__tags", "tags"))
    else:
        joined = joined.withColumnRenamed("__tags", "tags").withColumn("__tags", F.lit(None))
    if "metadata" in keep:
        # Sample metadata overrides the provenance keys.
        for c in ("category", "subcategory", "subtopic", "theme"):
            if c in keep:
                joined = joined.withColumn(c, F.coalesce(F.try_element_at("metadata", F.lit(c)), F.col(c)))
    return joined.drop("__tags")


def feedback_column(errors: Column) -> Column:
    """Feedback texts as one bullet list for a retry prompt."""
    return F.concat_ws("\n", F.transform(errors, lambda e: F.concat(F.lit("- "), e)))
