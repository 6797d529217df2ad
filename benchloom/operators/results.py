"""From responses to normalized rows, scores and the wide experiment dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.functions import signals, variants as V
from benchloom.functions.replies import ReplySpec, json_payload, reasoning_tail, structured_reply
from benchloom.functions.text import blank_to_null, java_pattern, pattern_error, strip_ws
from benchloom.operators.keyed import last_wins, preference

# Results of one record id from which on the pairs with its judge replies are made in several tasks.
CELL_ROWS = 250

_CARRY = [
    "task_id", "benchmark_id", "request_id", "case_id", "target_model", "source_run_id", "source_record_id", "split", "group_key",
]


def _carry(df: DataFrame) -> list[str]:
    return [c for c in _CARRY if c in df.columns]


# --- T12 ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Normalizer:
    """A built-in (``text``) or ``structural`` normalizer, with an optional reply spec."""

    normalizer_id: str
    kind: str = "text"
    spec: ReplySpec | None = None
    mode: str = ""
    accepted_types: tuple[str, ...] = ()


def _normalize_one(results: DataFrame, n: Normalizer, reply: str) -> DataFrame:
    text = strip_ws(F.coalesce(F.col(reply), F.lit("")))
    rows = results.where(F.col("artifact_type").isin(list(n.accepted_types))) if n.accepted_types else results
    # The reply is parsed once per row; everything below reads the parsed struct.
    staged = rows.withColumn("__text", text)
    nothing = F.lit(None).cast("string")
    if n.spec is not None or n.kind == "structural":
        meta = F.col("artifact_metadata") if "artifact_metadata" in rows.columns else None
        staged = staged.withColumn("__parsed", structured_reply(F.col("__text"), n.spec or ReplySpec(), n.mode, meta))
        value = lambda k: F.try_element_at(F.col("__parsed.fields"), F.lit(k))
        trace, source = F.col("__parsed.trace_text"), F.col("__parsed.trace_source")
        hits, spares = F.col("__parsed.raw_hits"), F.col("__parsed.fallback_source")
        status, missing = F.col("__parsed.status"), F.col("__parsed.missing")
    else:
        value = lambda k: nothing
        trace, source, status, missing = nothing, F.lit("none"), nothing, F.array().cast("array<string>")
        hits = spares = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    if n.kind == "structural":
        decision = F.coalesce(value("final_choice"), value("final_answer"), signals.first_visible_line(F.col("__text")))
        refusal = signals.structural_refusal(F.col("__text"))
        thinking = F.coalesce(value("thinking"), trace)
        compares = r"\b(option|choice|compared?|between)\b"
    elif n.kind == "text":
        decision = signals.decision(F.col("__text"), value("final_choice"), value("final_answer"), value("text"))
        refusal = signals.refusal(F.col("__text"))
        thinking = F.coalesce(trace, reasoning_tail(F.col("__text")))
        compares = r"\b(option|choice|compare)\b"
    else:
        raise ValueError(f"unsupported normalizer kind: {n.kind}")
    conf = signals.confidence(F.col("__text"))
    feats = signals.features(F.col("__text"), compares)
    return staged.select(
        *_carry(results),
        F.lit(n.normalizer_id).alias("normalizer_id"),
        F.lit("success").alias("status"),
        decision.alias("decision_text"),
        refusal.alias("refusal_flag"),
        conf["value"].alias("confidence_value"),
        conf["label"].alias("confidence_label"),
        thinking.alias("reasoning_trace_text"),
        F.struct(
            feats["chars"].alias("response_length_chars"),
            feats["words"].alias("response_length_words"),
            feats["compares"].alias("contains_option_comparison"),
            status.alias("parse_status"),
            missing.alias("missing_required"),
            hits.alias("raw_hits"),
            spares.alias("fallback_source"),
        ).alias("extracted"),
        F.struct(decision.alias("recommended_action"), refusal.alias("refusal_flag"), value("reason").alias("justification_text")).alias("comparability"),
        F.struct(thinking.alias("reasoning_trace_text"), source.alias("reasoning_trace_source")).alias("introspection"),
    )


NORMALIZER_KINDS = ("text", "structural")


def normalizer_failures(results: DataFrame, normalizers: list[Normalizer]) -> DataFrame:
    """A row per result and normalizer of an unsupported kind: stage, normalizer_id, error."""
    bad = F.array(
        *[F.struct(F.lit(n.normalizer_id).alias("normalizer_id"), F.lit(f"unsupported normalizer kind: {n.kind}").alias("error")) for n in normalizers if n.kind not in NORMALIZER_KINDS]
    ).cast("array<struct<normalizer_id:string,error:string>>")
    return results.select(*_carry(results), F.explode(bad).alias("f")).select(*_carry(results), F.lit("normalizer").alias("stage"), "f.normalizer_id", "f.error")


def normalize_results(results: DataFrame, normalizers: list[Normalizer], reply: str = "response_text") -> DataFrame:
    """Normalized rows of every normalizer, one projection each; see ``normalizer_failures`` for kinds that are none."""
    out = None
    for n in [n for n in normalizers if n.kind in NORMALIZER_KINDS] or [Normalizer("none")]:
        rows = _normalize_one(results, n, reply)
        out = rows if out is None else out.unionByName(rows)
    return out if any(n.kind in NORMALIZER_KINDS for n in normalizers) else out.limit(0)


# --- T13 ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    scorer_id: str
    rule_type: str
    patterns: tuple[str, ...]
    labels: tuple[str, ...] = ()
    score_name: str = "matched"


RULE_TYPES = ("contains_any", "regex_any", "exact_match")


def _rule_match(rule: Rule, text: Column) -> Column:
    hit = F.lit(False)
    for p in rule.patterns:
        if rule.rule_type == "contains_any":
            hit = hit | F.lower(text).contains(p.lower())
        elif rule.rule_type == "regex_any":
            hit = hit | text.rlike("(?iU)" + java_pattern(p))
        else:
            hit = hit | (strip_ws(text) == p.strip())
    return hit


def _rule_error(spark: SparkSession, rule: Rule) -> str | None:
    if rule.rule_type not in RULE_TYPES:
        return f"unsupported rule type: {rule.rule_type}"
    if rule.rule_type != "regex_any":
        return None
    return next((f"bad pattern {p}: {e}" for p in rule.patterns if (e := pattern_error(spark, "(?iU)" + java_pattern(p)))), None)


def rule_scores(results: DataFrame, rules: list[Rule], reply: str = "response_text") -> tuple[DataFrame, DataFrame]:
    """(scores, failures).  All rules are one projection followed by one explode; no join.

    A rule of an unknown type or with a pattern that cannot be compiled gives failures, the
    other rules their scores.
    """
    text = F.coalesce(F.col(reply), F.lit(""))
    errors = {r.scorer_id: _rule_error(results.sparkSession, r) for r in rules}
    known = [r for r in rules if errors[r.scorer_id] is None]
    unknown = [r for r in rules if errors[r.scorer_id] is not None]
    scored = F.array(
        *[
            F.struct(
                F.lit(r.scorer_id).alias("scorer_id"),
                F.lit(r.score_name).alias("score_name"),
                F.lit(r.rule_type).alias("rule_type"),
                F.array(*[F.lit(x) for x in (r.labels or (r.scorer_id,))]).alias("hit_labels"),
                _rule_match(r, text).alias("matched"),
            )
            for r in known
        ]
    )
    none = F.array().cast("array<string>")
    scores = None
    if known:
        scores = results.select(*_carry(results), F.explode(scored).alias("r")).select(
            *_carry(results),
            F.col("r.scorer_id").alias("scorer_id"),
            F.lit("success").alias("status"),
            F.when(F.col("r.matched"), F.col("r.hit_labels")).otherwise(none).alias("labels"),
            F.create_map(F.col("r.score_name"), F.when(F.col("r.matched"), 1.0).otherwise(0.0)).alias("scores"),
            F.concat(F.lit("rule_type="), F.col("r.rule_type")).alias("rationale"),
        )
    failed = results.select(
        *_carry(results),
        F.explode(
            F.array(*[F.struct(F.lit(r.scorer_id).alias("scorer_id"), F.lit(errors[r.scorer_id]).alias("error")) for r in unknown])
            if unknown
            else F.array().cast("array<struct<scorer_id:string,error:string>>")
        ).alias("f"),
    ).select(*_carry(results), F.lit("rule_scorer").alias("stage"), "f.scorer_id", "f.error")
    if scores is None:
        typed = {"status": "string", "labels": "array<string>", "scores": "map<string,double>", "rationale": "string"}
        scores = failed.where(F.lit(False)).select(*_carry(results), "scorer_id", *[F.lit(None).cast(k).alias(c) for c, k in typed.items()])
    return scores, failed


# --- T14, J5 --------------------------------------------------------------------------
def parse_annotations(replies: DataFrame, required: list[str] = (), reply: str = "raw_reply", spec: ReplySpec | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotations with an ``annotation`` VARIANT, parse failures).

    Without a spec, or with one for JSON, the object in the reply is the annotation; with
    another format the fields that the spec finds are.  Required keys are checked by presence.
    """
    if spec is None or spec.format in ("json", "json_object"):
        annotation = json_payload(reply)
    else:
        found = F.to_json(structured_reply(reply, spec)["fields"])
        annotation = F.when(blank_to_null(reply).isNotNull(), F.parse_json(found))
    parsed = replies.withColumn("annotation", annotation)
    absent = F.filter(
        F.array(*[F.when(~V.has_key("annotation", k), F.lit(k)) for k in required]).cast("array<string>"), lambda x: x.isNotNull()
    )
    error = (
        F.when(blank_to_null(reply).isNull(), "annotation reply is empty")
        .when(F.col("annotation").isNull(), "annotation reply holds no object")
        .when(F.size(absent) > 0, F.concat(F.lit("missing required keys: "), F.concat_ws(", ", absent)))
    )
    tagged = parsed.withColumn("error_message", error)
    good = tagged.where(F.col("error_message").isNull()).drop("error_message")
    return good, tagged.where(F.col("error_message").isNotNull()).withColumn("stage", F.lit("parse")).drop("annotation")


def judgement(annotation: Column | str = "annotation") -> dict[str, Column]:
    """labels, scores, score_texts and rationale of a parsed judge reply."""
    a = annotation if isinstance(annotation, str) else annotation
    action = F.nullif(V.get_text(a, "recommended_action"), F.lit(""))
    none = F.array().cast("array<string>")
    labels = F.coalesce(V.text_list(V.get(a, "labels")), V.text_list(V.get(a, "normative_labels")), F.when(action.isNotNull(), F.array(action)), none)
    numbers = F.array(
        *[
            F.when(V.get_number(a, k).isNotNull(), F.struct(F.lit(k).alias("k"), V.get_number(a, k).alias("v")))
            for k in ("confidence", "score")
        ]
    )
    # a score that is no number is kept as text; averages use the numbers only
    words = F.array(
        *[
            F.when(V.get_number(a, k).isNull() & V.get_text(a, k).isNotNull(), F.struct(F.lit(k).alias("k"), V.get_text(a, k).alias("v")))
            for k in ("confidence", "score")
        ]
    )
    rationale = F.coalesce(*[F.nullif(V.get_text(a, k), F.lit("")) for k in ("rationale", "primary_justification", "summary")])
    return {
        "labels": labels,
        "scores": F.map_from_entries(F.filter(numbers, lambda e: e.isNotNull())),
        "score_texts": F.map_from_entries(F.filter(words, lambda e: e.isNotNull())),
        "rationale": rationale,
    }


def judge_to_scores(annotations: DataFrame, results: DataFrame, scorer_id: str) -> DataFrame:
    """Score records of parsed judge replies.

    Joined on run *and* record id, since record ids restart in every run.  Replies
    without a result are dropped.
    """
    j = judgement("annotation")
    slim = annotations.select(
        "source_run_id",
        "source_record_id",
        F.coalesce(F.col("annotation_status") if "annotation_status" in annotations.columns else F.lit(None), F.lit("success")).alias("status"),
        *[c.alias(k) for k, c in j.items()],
        F.col("annotation").alias("raw_judgment"),
    )
    keep = [c for c in _carry(results) if c not in ("source_run_id", "source_record_id")]
    joined = _spread_join(slim, results.select("source_run_id", "source_record_id", *keep), ["source_run_id", "source_record_id"])
    return joined.withColumn("scorer_id", F.lit(scorer_id))


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` whose pairs of one key are made in several tasks.

    The right rows of a key that has more than ``CELL_ROWS`` are dealt to cells of about that
    many by a hash of their texts, and the left ones copied to each; other keys stay as they
    are.  The number of tasks is given, since rows are few beside their pairs and would be put
    together; a broadcast is ruled out, as Spark would judge it by the rows before the copying.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cells = F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int")
    large = right.groupBy(*keys).agg(cells.alias("__cells")).where("__cells > 1")
    many = F.coalesce("__cells", F.lit(1))
    texts = [f.name for f in right.schema.fields if f.dataType == T.StringType()]
    dealt = right.join(large, keys, "left").withColumn("__cell", F.pmod(F.xxhash64(*(texts or keys)), many).cast("int")).drop("__cells")
    copied = left.join(large, keys, "left").withColumn("__cell", F.explode(F.sequence(F.lit(0), many - 1))).drop("__cells")
    on = [*keys, "__cell"]
    return copied.repartition(tasks, *on).join(dealt.repartition(tasks, *on).hint("merge"), on).drop("__cell")


def judge_scores(replies: DataFrame, results: DataFrame, scorer_id: str, required: list[str] = (), reply: str = "raw_reply", spec: ReplySpec | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, parse failures) straight from raw judge replies, in the format of ``spec``."""
    good, bad = parse_annotations(replies, required, reply, spec)
    return judge_to_scores(good, results, scorer_id), bad


# --- J4, J11, J3 ----------------------------------------------------------------------
def scores_for_results(results: DataFrame, scores: DataFrame, on: str = "case_id") -> DataFrame:
    """Scores matched to results on target and case (or request) id.

    By case id, k results of one target and case see every score of that case.
    """
    extra = [c for c in scores.columns if c not in results.columns]
    return results.join(scores.select("target_model", on, *extra), ["target_model", on])


def judge_context(results: DataFrame, normalized: DataFrame) -> DataFrame:
    """Results with their normalized row; of several normalizers the last one wins."""
    keys = ["source_run_id", "source_record_id"]
    fields = ["decision_text", "refusal_flag", "confidence_value", "confidence_label", "reasoning_trace_text"]
    slim = normalized.select(*keys, "normalizer_id", *[f for f in fields if f in normalized.columns])
    last = last_wins(slim, keys, ["normalizer_id"])
    return results.join(last, keys, "left")


def _by_scorer(fields: list[str]):
    """Compares score records by the text fields they have; maps cannot be ordered."""

    def compare(a: Column, b: Column) -> Column:
        key = lambda s: F.struct(*[s[f].cast("string").alias(f) for f in ("scorer_id", "status", "rationale") if f in fields])
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    return compare


def _one_each(df: DataFrame, key: str, order: str | None) -> DataFrame:
    hashed = df.withColumn("__order", F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]))
    return last_wins(hashed, [key], [order, "__order"] if order else ["__order"]).drop("__order")


def experiment_dataset(
    results: DataFrame, cases: DataFrame, requests: DataFrame, normalized: DataFrame, scores: DataFrame, order: str | None = None
) -> DataFrame:
    """One wide row per target result.

    The many-sides are folded to one row per (request, target) before they are joined; an
    array holds at most one entry per normalizer or scorer, in the order of their ids.  Of cases
    or requests with one id the last by the column ``order`` counts, without it that with the
    greatest content hash.
    """
    keys = ["request_id", "target_model"]
    norm_fields = [c for c in ("normalizer_id", "status", "decision_text", "refusal_flag", "reasoning_trace_text") if c in normalized.columns]
    score_fields = [c for c in ("scorer_id", "status", "labels", "scores", "rationale") if c in scores.columns]
    entry = F.struct(*norm_fields)
    # The list, its length and the preferred row come out of one pass over the layer.
    folded = normalized.groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("normalized_results"),
        F.count("*").alias("normalized_result_count"),
        F.min_by(entry, preference()).alias("__best"),
    )
    by_norm = folded.select(
        *keys, "normalized_results", "normalized_result_count", *[F.col("__best")[c].alias(c) for c in norm_fields if c not in ("normalizer_id", "status")]
    )
    by_score = scores.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*score_fields)), _by_scorer(score_fields)).alias("score_records"), F.count("*").alias("score_record_count")
    )
    case_side = _one_each(cases, "case_id", order).select(
        "case_id",
        *[F.col(c).alias(f"case_{c}") for c in ("prompt", "split", "tags", "case_version", "source_builder", "grouping", "metadata") if c in cases.columns],
    )
    request_side = _one_each(requests, "request_id", order).select("request_id", F.struct(*[c for c in ("task_id", "target_model", "case_id") if c in requests.columns]).alias("execution_request"))
    wide = (
        results.join(case_side, "case_id", "left")
        .join(request_side, "request_id", "left")
        .join(by_norm, keys, "left")
        .join(by_score, keys, "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = wide.withColumns(
        {"normalized_result_count": zero("normalized_result_count"), "score_record_count": zero("score_record_count")}
    )
    if "case_split" in out.columns and "split" in out.columns:
        out = out.withColumn("split", F.coalesce(F.nullif("split", F.lit("")), F.nullif("case_split", F.lit("")), F.lit("default")))
    return out
