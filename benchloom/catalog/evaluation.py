"""Queries over replies, scores, joins and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.catalog.views import Tables, query
from benchloom.functions import replies as RP
from benchloom.functions import signals as SG
from benchloom.operators import keyed as K
from benchloom.operators import results as RS
from benchloom.operators import runs as RN
from benchloom.operators import summaries as SM
from benchloom.plans.hooks import Hooks

# Word bounds that treat accented letters as letters in the SQL engine too.
LB, RB = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"

SPEC = RP.ReplySpec(
    fields=("final_choice", "final_answer", "reason"),
    aliases={"final_choice": ["final_choice", "choice"], "reason": ["reason", "why"]},
    required=("final_choice",),
    preferred_in={"final_answer": ["open"]},
    fallbacks={"reason": [r"confidence:\s*([0-9.]+)"]},
    choices={"A": ["option a", "first"], "B": ["option b"]},
    trace_patterns=(r"I (refuse)\.",),
)

JSON_SQL = """
select *, case when turn % 4 = 1 then 'bare' when turn % 4 = 2 then 'fenced' when turn % 4 = 3 then 'none' else 'partial' end as form from v_results"""


def json_replies(t: Tables) -> DataFrame:
    """Replies holding a bare, fenced, missing or partial JSON object."""
    full = F.to_json(F.struct(F.lit("A").alias("choice"), F.col("response_text").alias("reason"), (F.col("turn") / 10).alias("confidence")))
    part = F.to_json(F.struct(F.lit("B").alias("final_choice"), F.lit("").alias("reason"), F.lit("").alias("why")))
    reply = (
        F.when(F.col("form") == "bare", F.concat(F.lit("Answer: "), full, F.lit(" done.")))
        .when(F.col("form") == "fenced", F.concat(F.lit("Here:\n```json\n"), full, F.lit("\n```\nbye")))
        .when(F.col("form") == "none", F.concat(F.lit("{no object} "), "response_text"))
        .otherwise(part)
    )
    return t.sql(JSON_SQL).withColumn("reply", reply)


@query(
    "T1_parse_json_replies",
    f"""
select source_record_id, case form when 'none' then 'invalid' when 'partial' then 'partial' else 'parsed' end as status,
  case form when 'none' then null when 'partial' then 'B' else 'A' end as final_choice, case when form in ('bare', 'fenced') then response_text end as reason,
  case form when 'none' then 'final_choice|reason' when 'partial' then 'reason' else '' end as missing,
  case when form in ('bare', 'fenced') then {STRIP.format(c="response_text")} when form = 'none' then concat('{{no object}} ', response_text) else '' end as text_value
from ({JSON_SQL})""",
)
def _(t):
    spec = RP.ReplySpec(aliases={"final_choice": ["choice"], "reason": ["why"]}, required=("final_choice", "reason"))
    parsed = json_replies(t).select("source_record_id", "form", "reply", RP.json_reply("reply", spec).alias("p"))
    value = F.when(F.col("form") != "partial", RP.json_text_value("reply", ["missing", "reason"])).otherwise("")
    at = lambda k: F.try_element_at("p.fields", F.lit(k)).alias(k)
    return parsed.select(
        "source_record_id", "p.status", at("final_choice"), at("reason"), F.concat_ws("|", "p.missing").alias("missing"), value.alias("text_value")
    )


@query(
    "T2_parse_tag_replies",
    """
select source_record_id, case when turn % 3 = 2 then 'partial' else 'parsed' end as status,
  case when turn % 3 = 0 then 'A' when turn % 3 = 1 then 'B' end as final_choice, case when turn % 3 = 2 then '0.4' end as reason,
  case when turn % 3 = 2 then 'final_choice|final_answer' else '' end as missing, case when turn % 3 = 2 then 'pattern' end as reason_source
from v_tagged""",
)
def _(t):
    parsed = t("v_tagged").select("source_record_id", RP.tag_reply("reply", SPEC, "open").alias("p"))
    at = lambda k: F.try_element_at("p.fields", F.lit(k)).alias(k)
    return parsed.select(
        "source_record_id", "p.status", at("final_choice"), at("reason"), F.concat_ws("|", "p.missing").alias("missing"),
        F.try_element_at("p.fallback_source", F.lit("reason")).alias("reason_source"),
    )


@query(
    "T3_parse_section_replies",
    f"""
select source_record_id, case when turn % 3 = 0 then target_model when turn % 3 = 1 then split end as choice,
  case when turn % 3 = 2 then '0.5' else {STRIP.format(c="response_text")} end as reason, case when turn % 3 = 2 then 'partial' else 'parsed' end as status
from v_results""",
)
def _(t):
    spec = RP.ReplySpec(
        fields=("final_choice", "reason"), aliases={"final_choice": ["Decision", "Choice"], "reason": ["Reason (short)", "Reason short"]},
        required=("final_choice",), fallbacks={"reason": [r"score=([0-9.]+)"]},
    )
    headings = F.concat(F.lit("# Choice\n"), "target_model", F.lit("\n## REASON (short)\n"), "response_text")
    labels = F.concat(F.lit("Choice: "), "split", F.lit("\nReason short: "), "response_text", F.lit("\nNotes: none"))
    reply = F.when(F.col("turn") % 3 == 0, headings).when(F.col("turn") % 3 == 1, labels).otherwise(F.concat(F.lit("score=0.5 "), "response_text"))
    parsed = t("v_results").select("source_record_id", RP.section_reply(reply, spec).alias("p"))
    at = lambda k: F.try_element_at("p.fields", F.lit(k))
    return parsed.select("source_record_id", at("final_choice").alias("choice"), at("reason").alias("reason"), "p.status")


@query(
    "T4_parse_plain_replies",
    f"""
with x as (select source_record_id, {STRIP.format(c="case when turn % 3 = 0 then '  ' else concat(' ', response_text, chr(10)) end")} as s from v_results)
select source_record_id, case when s = '' then 'invalid' else 'parsed' end as status, nullif(s, '') as text from x""",
)
def _(t):
    reply = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "response_text", F.lit("\n")))
    return t("v_results").select("source_record_id", RP.plain_reply(reply).alias("p")).select("source_record_id", "p.status", "p.text")


@query(
    "T5_reasoning_trace",
    f"""
select source_record_id, case when turn % 5 = 0 then 'from metadata' when turn % 3 = 1 then {STRIP.format(c="response_text")} when turn % 3 = 2 then 'refuse' end as trace,
  case when turn % 5 = 0 then 'artifact_metadata' when turn % 3 = 1 then 'tag' when turn % 3 = 2 then 'text_pattern' else 'none' end as source,
  case when turn % 3 = 0 then {STRIP.format(c="substr(response_text, 1, 1000)")} end as tail
from v_results""",
)
def _(t):
    meta = F.when(F.col("turn") % 5 == 0, F.parse_json(F.lit('{"thinking_content": " from metadata "}')))
    reply = (
        F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<Thinking>"), "response_text", F.lit("</thinking>")))
        .when(F.col("turn") % 3 == 2, "I refuse.")
        .otherwise(F.concat(F.lit("ok, BECAUSE: "), "response_text"))
    )
    df = t("v_results").select("source_record_id", reply.alias("reply"), meta.alias("m"), "turn")
    trace = df.select("source_record_id", RP.reasoning_trace("reply", SPEC, F.col("m")).alias("t"), RP.reasoning_tail("reply").alias("tail"))
    return trace.select("source_record_id", F.col("t.text").alias("trace"), F.col("t.source").alias("source"), "tail")


@query(
    "T6_normalize_choice",
    """
select source_record_id, case turn % 4 when 0 then 'A' when 1 then 'B' when 2 then 'A' else response_text end as choice from v_results""",
)
def _(t):
    raw = (
        F.when(F.col("turn") % 4 == 0, " Option A ").when(F.col("turn") % 4 == 1, "b").when(F.col("turn") % 4 == 2, "FIRST").otherwise(F.concat(F.col("response_text"), F.lit(" ")))
    )
    return t("v_results").select("source_record_id", RP.normalize_choice(raw, SPEC.choices).alias("choice"))


@query(
    "T7_required_missing",
    """
select source_record_id, concat_ws('|', case when turn % 2 = 0 then 'final_choice' end, case when turn % 3 = 0 then 'reason' end,
  case when turn % 2 = 0 then 'final_answer' end) as missing from v_results""",
)
def _(t):
    spec = RP.ReplySpec(required=("final_choice",), required_in={"reason": ["strict"]}, preferred_in={"final_answer": ["strict"]})
    values = {"final_choice": F.when(F.col("turn") % 2 != 0, "A"), "reason": F.when(F.col("turn") % 3 != 0, F.col("response_text"))}
    return t("v_results").select("source_record_id", F.concat_ws("|", RP.missing_required(values, spec, "strict")).alias("missing"))


REFUSE = "(" + " or ".join(f"contains(lower(r), '{m.replace(chr(39), chr(39) * 2)}')" for m in SG.fixed.REFUSAL_MARKERS) + ")"
REFUSE_STRUCT = "(" + " or ".join(f"contains(lower(r), '{m.replace(chr(39), chr(39) * 2)}')" for m in SG.fixed.STRUCTURAL_REFUSAL_MARKERS) + ")"


@query(
    "T8_detect_refusal",
    f"""
with x as (select source_record_id, case when turn % 5 = 0 then ' ' else reply end as r from v_tagged)
select source_record_id, trim(r) = '' or {REFUSE} as refusal, {REFUSE_STRUCT} as structural from x""",
)
def _(t):
    r = F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("reply"))
    return t("v_tagged").select("source_record_id", SG.refusal(r).alias("refusal"), SG.structural_refusal(r).alias("structural"))


@query(
    "T9_decision_text",
    rf"""
select source_record_id, case when turn % 3 = 0 then 'A' else substr({STRIP.format(c="split_part(response_text, chr(10), 1)")}, 1, 400) end as decision,
  case when turn % 3 = 0 then '<choice>option a</choice>' when turn % 3 = 1 then '<final_choice> B </final_choice>' else 'sorry, I refuse. confidence: 0.4' end as visible
from v_tagged""",
)
def _(t):
    choice = F.when(F.col("turn") % 3 == 0, " A ")
    return t("v_tagged").select("source_record_id", SG.decision("response_text", choice).alias("decision"), SG.first_visible_line("reply").alias("visible"))


def _conf_sql(c: str) -> str:
    words = " ".join(f"when regexp_matches(lower({c}), '{LB}{w}{RB}') then '{w}'" for w in ("high", "medium", "low", "uncertain"))
    return words


@query(
    "T10_confidence_signal",
    f"""
with x as (select source_record_id, case turn % 3 when 2 then reply when 1 then concat(response_text, ' low and HIGH.') else response_text end as r from v_tagged)
select source_record_id, cast(nullif(regexp_extract(lower(r), '{LB}confidence[:\\s]+([0-9]+(?:\\.[0-9]+)?)', 2), '') as double) as value,
  case when regexp_matches(lower(r), '{LB}confidence[:\\s]+[0-9]') then null {_conf_sql("r")} end as label from x""",
)
def _(t):
    r = F.when(F.col("turn") % 3 == 2, F.col("reply")).when(F.col("turn") % 3 == 1, F.concat(F.col("response_text"), F.lit(" low and HIGH."))).otherwise(F.col("response_text"))
    return t("v_tagged").select("source_record_id", SG.confidence(r).alias("c")).select("source_record_id", "c.value", "c.label")


@query(
    "T11_reply_features",
    f"""
select doc_id, length(text) as chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words,
  regexp_matches(lower(text), '{LB}(option|choice|compare){RB}') as compares from documents""",
)
def _(t):
    return t("documents").select("doc_id", SG.features("text").alias("f")).select("doc_id", "f.chars", "f.words", "f.compares")


def normalizers() -> list[RS.Normalizer]:
    return [RS.Normalizer("builtin"), RS.Normalizer("tagged", spec=SPEC), RS.Normalizer("structural", kind="structural", spec=SPEC)]


def normalized(t: Tables) -> DataFrame:
    return RS.normalize_results(t("v_tagged"), normalizers(), "reply")


FIRST = rf"substr({STRIP.format(c='split_part(reply, chr(10), 1)')}, 1, 400)"
NORMALIZED_SQL = f"""
select source_run_id, source_record_id, request_id, target_model, case_id, split, group_key, n.normalizer_id, 'success' as status,
  case when n.normalizer_id = 'builtin' then {FIRST}
       when turn % 3 = 0 then 'A' when turn % 3 = 1 then 'B' when n.normalizer_id = 'tagged' then {FIRST}
       else 'sorry, I refuse. confidence: 0.4' end as decision_text,
  turn % 3 = 2 as refusal_flag, case when turn % 3 = 2 then 0.4e0 end as confidence_value,
  case when n.normalizer_id = 'builtin' then null else {STRIP.format(c="response_text")} end as reasoning_trace_text
from v_tagged cross join (select 'builtin' as normalizer_id union all select 'tagged' union all select 'structural') n"""


@query(
    "T12_normalize_results",
    f"select source_record_id, normalizer_id, status, decision_text, refusal_flag, confidence_value, reasoning_trace_text from ({NORMALIZED_SQL})",
)
def _(t):
    return normalized(t).select("source_record_id", "normalizer_id", "status", "decision_text", "refusal_flag", "confidence_value", "reasoning_trace_text")


RULES = [
    RS.Rule("has_de", "contains_any", ("DE LA", " und "), ("latin",)),
    RS.Rule("vowels", "regex_any", (r"(eau|oua)x?\b", r"zzz+"), (), "vowel"),
    RS.Rule("exact", "exact_match", (" never ", "x"), ("same",)),
]
RULE_SQL = f"""
select source_record_id, source_run_id, request_id, case_id, target_model, split, group_key, s.scorer_id, s.score_name,
  case s.scorer_id when 'has_de' then contains(lower(response_text), 'de la') or contains(lower(response_text), ' und ')
    when 'vowels' then regexp_matches(lower(response_text), '(eau|oua)x?{RB}') or contains(lower(response_text), 'zzz')
    else {STRIP.format(c="response_text")} in ('never', 'x') end as matched,
  case s.scorer_id when 'has_de' then 'latin' when 'vowels' then 'vowels' else 'same' end as label
from v_results cross join (select 'has_de' as scorer_id, 'matched' as score_name union all select 'vowels', 'vowel' union all select 'exact', 'matched') s"""


@query(
    "T13_rule_scores",
    f"""
select source_record_id, scorer_id, case when matched then label else '' end as labels, score_name, case when matched then 1.0e0 else 0.0e0 end as score, null as error from ({RULE_SQL})
union all select source_record_id, 'odd', '', null, null, 'unsupported rule type: fuzzy' from v_results""",
)
def _(t):
    scores, failed = RS.rule_scores(t("v_results"), [*RULES, RS.Rule("odd", "fuzzy", ("x",))])
    rows = scores.select("source_record_id", "scorer_id", F.concat_ws("|", "labels").alias("labels"), F.explode("scores").alias("score_name", "score"))
    bad = failed.select("source_record_id", "scorer_id", F.lit("").alias("labels"), "error")
    return rows.unionByName(bad, allowMissingColumns=True)


def judge_replies(t: Tables) -> DataFrame:
    """Judge replies: labels, normative labels, an action only, or no JSON."""
    c = F.col("turn") % 4
    reply = (
        F.when(c == 0, F.to_json(F.struct(F.array("group_key", "split").alias("labels"), (F.col("turn") / 10).alias("confidence"), F.col("response_text").alias("rationale"))))
        .when(c == 1, F.to_json(F.struct(F.array("split").alias("normative_labels"), F.col("turn").alias("score"), F.lit(True).alias("confidence"), F.lit("s").alias("summary"))))
        .when(c == 2, F.to_json(F.struct(F.col("target_model").alias("recommended_action"))))
        .otherwise(F.col("response_text"))
    )
    return t("v_results").select("source_run_id", "source_record_id", "group_key", "target_model", F.concat(F.lit("verdict: "), reply).alias("raw_reply"))


@query(
    "T14_judge_scores",
    """
select source_record_id, 'judge' as scorer_id, case turn % 4 when 0 then concat(group_key, '|', split) when 1 then split else target_model end as labels,
  case when turn % 4 = 0 then turn / 10.0e0 end as confidence, case when turn % 4 = 1 then cast(turn as double) end as score,
  case turn % 4 when 0 then response_text when 1 then 's' end as rationale, null as error
from v_results where turn % 4 <> 3
union all select source_record_id, 'judge', '', null, null, null, 'annotation reply holds no object' from v_results where turn % 4 = 3""",
)
def _(t):
    scores, bad = RS.judge_scores(judge_replies(t), t("v_results"), "judge")
    at = lambda k: F.try_element_at("scores", F.lit(k)).alias(k)
    rows = scores.select("source_record_id", "scorer_id", F.concat_ws("|", "labels").alias("labels"), at("confidence"), at("score"), "rationale")
    failed = bad.select("source_record_id", F.lit("judge").alias("scorer_id"), F.lit("").alias("labels"), F.col("error_message").alias("error"))
    return rows.unionByName(failed, allowMissingColumns=True)


# --- joins ----------------------------------------------------------------------------
@query(
    "J2_attach_responses",
    """
select concat('task:', r.target_model, ':', r.case_id) as request_id, r.target_model, r.case_id, c.family_id, r.source_record_id, r.response_text, null as error from v_results r join
  (select concat('conv_', cast(doc_id as varchar(20))) as case_id, source as family_id from documents) c on r.case_id = c.case_id
union all select null, 'model_9', null, null, null, null, 'no response rows for target'""",
)
def _(t):
    """Several responses to one request all attach; a target without any is a failure row."""
    from benchloom.operators import requests as RQ

    targets = ["model_0", "model_1", "model_2", "model_9"]
    cases = t("documents").select(F.concat(F.lit("conv_"), F.col("doc_id").cast("string")).alias("case_id"), F.col("source").alias("family_id"))
    requests = RQ.expand_requests(cases, targets, "task")
    responses = t("v_results").select(F.concat_ws(":", F.lit("task"), "target_model", "case_id").alias("prompt_id"), "target_model", "source_record_id", "response_text")
    results, failures = RQ.attach_responses(requests, responses, targets)
    good = results.select("request_id", "target_model", "case_id", "family_id", "source_record_id", "response_text")
    return good.unionByName(failures.select("target_model", "error"), allowMissingColumns=True)


def scores_frame(t: Tables) -> DataFrame:
    return t("v_scores").select(
        "source_run_id", "source_record_id", "request_id", "target_model", "case_id", "scorer_id", F.lit("success").alias("status"),
        F.array("label").alias("labels"), F.create_map("score_name", "score").alias("scores"),
    )


@query(
    "J3_experiment_dataset",
    f"""
with n as ({NORMALIZED_SQL}), s as (select request_id, target_model, count(*) as n_scores from v_scores group by 1, 2)
select r.source_record_id, r.split, c.lang as case_language, n.decision_text, 3 as normalized_result_count, s.n_scores as score_record_count
from v_results r left join (select concat('conv_', cast(doc_id as varchar(20))) as case_id, lang from documents) c on r.case_id = c.case_id
join n on n.request_id = r.request_id and n.target_model = r.target_model and n.normalizer_id = 'builtin'
left join s on s.request_id = r.request_id and s.target_model = r.target_model""",
)
def _(t):
    cases = t("documents").select(F.concat(F.lit("conv_"), F.col("doc_id").cast("string")).alias("case_id"), F.create_map(F.lit("lang"), F.col("lang")).alias("grouping"))
    requests = t("v_results").select("request_id", "target_model", "case_id")
    wide = RS.experiment_dataset(t("v_results"), cases, requests, normalized(t), scores_frame(t))
    return wide.select(
        "source_record_id", "split", F.try_element_at("case_grouping", F.lit("lang")).alias("case_language"), "decision_text", "normalized_result_count", "score_record_count"
    )


@query(
    "J4_scores_for_results",
    """
select r.source_record_id, s.scorer_id, count(*) as n, round(sum(s.score), 6) as total from v_results r join v_scores s
  on r.target_model = s.target_model and r.case_id = s.case_id group by 1, 2""",
)
def _(t):
    scores = t("v_scores").select("target_model", "case_id", "scorer_id", "score")
    joined = RS.scores_for_results(t("v_results"), scores)
    return joined.groupBy("source_record_id", "scorer_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


COLLIDE = "concat('rec_', cast(turn as varchar(20)), '_', cast(conv_id % 7 as varchar(20)))"


@query(
    "J5_judge_to_scores",
    f"""
with r as (select *, {COLLIDE} as rid from v_results)
select a.source_run_id, a.rid as source_record_id, b.request_id, a.target_model as action from r a join r b on a.source_run_id = b.source_run_id and a.rid = b.rid""",
)
def _(t):
    # Record ids restart in every run, so the same id occurs in all three.
    results = t.sql(f"select source_run_id, {COLLIDE} as source_record_id, request_id, target_model, case_id, split, group_key from v_results")
    ann = results.select(
        "source_run_id", "source_record_id", F.parse_json(F.to_json(F.struct(F.col("target_model").alias("recommended_action")))).alias("annotation")
    )
    return RS.judge_to_scores(ann, results, "judge").select("source_run_id", "source_record_id", "request_id", F.get("labels", F.lit(0)).alias("action"))


@query(
    "J11_judge_context",
    f"""
with n as ({NORMALIZED_SQL}) select r.source_run_id, r.source_record_id, n.normalizer_id, n.decision_text, n.refusal_flag
from v_results r left join n on n.source_run_id = r.source_run_id and n.source_record_id = r.source_record_id and n.normalizer_id = 'tagged'""",
)
def _(t):
    return RS.judge_context(t("v_results"), normalized(t)).select("source_run_id", "source_record_id", "normalizer_id", "decision_text", "refusal_flag")


@query(
    "W4_preferred_normalized",
    """
with n as (select request_id, target_model, scorer_id as normalizer_id, case when score_name = 'short' and label = 'odd' then 'failed' else 'success' end as status, score from v_scores),
r as (select *, row_number() over (partition by request_id, target_model order by case when status = 'success' then 0 else 1 end, normalizer_id) as rn from n)
select request_id, target_model, normalizer_id, status, score from r where rn = 1""",
)
def _(t):
    n = t("v_scores").select(
        "request_id", "target_model", F.col("scorer_id").alias("normalizer_id"),
        F.when((F.col("score_name") == "short") & (F.col("label") == "odd"), "failed").otherwise("success").alias("status"), "score",
    )
    return K.preferred_normalized(n)


@query(
    "W9_last_wins",
    """
with r as (select *, row_number() over (partition by model_name, prompt_id order by event_id desc) as a, row_number() over (partition by model_name, prompt_id order by event_id) as b from v_ledger)
select model_name, prompt_id, max(case when a = 1 then status end) as last_status, max(case when b = 1 then status end) as first_status from r group by 1, 2""",
)
def _(t):
    keys = ["model_name", "prompt_id"]
    led = t("v_ledger").select(*keys, "status", "event_id")
    last = K.last_wins(led, keys, ["event_id"]).select(*keys, F.col("status").alias("last_status"))
    first = K.first_wins(led, keys, ["event_id"]).select(*keys, F.col("status").alias("first_status"))
    return last.join(first, keys)


# --- summaries ------------------------------------------------------------------------
A1_SQL = """
with sizes as (select target_model, split, group_key, count(*) as case_count from v_results group by 1, 2, 3),
j as (select r.target_model, r.split, r.group_key, s.scorer_id, s.score_name, s.score, s.label from v_results r join v_scores s on r.target_model = s.target_model and r.case_id = s.case_id),
g as (select target_model, split, group_key, scorer_id, score_name, count(*) as n, round(avg(score), 6) as mean_score,
  count(*) filter (where label = 'even') as n_even, count(*) filter (where label = 'odd') as n_odd from j group by 1, 2, 3, 4, 5)"""


@query(
    "A1_group_summary",
    f"""{A1_SQL}
select z.target_model, z.split, z.group_key, g.scorer_id, z.case_count, coalesce(g.n, 0) as score_record_count,
  case when g.scorer_id is null then '' else concat_ws('|', case when n_even > 0 then 'even' end, case when n_odd > 0 then 'odd' end) end as labels,
  nullif(g.n_even, 0) as n_even, nullif(g.n_odd, 0) as n_odd, g.score_name, g.mean_score
from sizes z left join g on z.target_model = g.target_model and z.split = g.split and z.group_key = g.group_key""",
)
def _(t):
    g = SM.group_summary(t("v_results"), scores_frame(t))
    at = lambda k: F.try_element_at("label_counts", F.lit(k))
    return g.select(
        "target_model", "split", "group_key", "scorer_id", "case_count", "score_record_count", F.concat_ws("|", "labels").alias("labels"),
        at("even").alias("n_even"), at("odd").alias("n_odd"), F.explode_outer("scores").alias("score_name", "mean_score"),
    ).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "A1_group_labels",
    """
select r.target_model, r.split, r.group_key, s.scorer_id, concat(s.label, '_', s.turn) as label, count(*) as n
from v_results r join (select s.*, r.turn from v_scores s join v_results r on r.source_record_id = s.source_record_id) s on r.target_model = s.target_model and r.case_id = s.case_id
group by 1, 2, 3, 4, 5""",
)
def _(t):
    """Every label of every group, in long form."""
    turns = t("v_results").select("source_record_id", "turn")
    scores = scores_frame(t).join(turns, "source_record_id").withColumn("labels", F.transform("labels", lambda x: F.concat_ws("_", x, F.col("turn").cast("string"))))
    return SM.group_labels(t("v_results"), scores)


@query(
    "A2_experiment_summary",
    f"""
with n as ({NORMALIZED_SQL})
select 'case_count' as metric, null as key, null as subkey, cast(count(distinct case_id) as double) as value from v_results
union all select 'target_result_count', null, null, count(*) from v_results
union all select 'counts_by_target_model', target_model, null, count(*) from v_results group by 2
union all select 'counts_by_split', split, null, count(*) from v_results group by 2
union all select 'normalized_result_count', null, null, count(*) from n
union all select 'counts_by_normalizer', normalizer_id, null, count(*) from n group by 2
union all select 'score_record_count', null, null, count(*) from v_scores
union all select 'counts_by_scorer', scorer_id, null, count(*) from v_scores group by 2
union all select 'group_analysis_record_count', null, null, 0
union all select 'analysis_plugin_result_count', null, null, 0
union all select 'failure_count', null, null, count(*) from v_ledger where status = 'failed'
union all select 'label_counts_by_target_model', target_model, label, count(*) from v_scores group by 2, 3
union all select 'average_numeric_score', scorer_id, score_name, round(avg(score), 6) from v_scores group by 2, 3""",
)
def _(t):
    s = SM.experiment_summary(t("v_results"), normalized(t), scores_frame(t), failures=t("v_ledger").where("status = 'failed'"))
    return s.withColumn("value", F.round("value", 6))


def annotations_frame(t: Tables) -> DataFrame:
    good, _bad = RS.parse_annotations(judge_replies(t))
    return good.select(
        "source_run_id", "source_record_id", F.col("group_key").alias("source_artifact_type"), F.col("target_model").alias("source_model_name"), F.lit("judge_x").alias("annotator_model")
    )


@query(
    "A5_annotation_stats",
    """
with a as (select * from v_results where turn % 4 <> 3)
select 'artifact_type' as metric, group_key as key, count(*) as n from a group by 2
union all select 'source_model', target_model, count(*) from a group by 2
union all select 'annotator_model', 'judge_x', count(*) from a
union all select 'annotation_count', null, count(*) from a
union all select 'failed_count', null, count(*) from v_results where turn % 4 = 3
union all select 'skipped_count', null, count(*) from v_results where split = 'test'""",
)
def _(t):
    _good, bad = RS.parse_annotations(judge_replies(t))
    return SM.annotation_stats(annotations_frame(t), bad, t("v_results").where("split = 'test'"))


FAMILY_SQL = """
select target_model, split, group_key as family_id, 'cases' as kind, '' as name, count(*) as n from v_results group by 1, 2, 3
union all select r.target_model, r.split, r.group_key, 'label', s.label, count(*) from v_results r join v_scores s on r.target_model = s.target_model and r.case_id = s.case_id group by 1, 2, 3, 5"""


@query(
    "A9_family_consistency",
    f"""
with n as ({NORMALIZED_SQL}) {FAMILY_SQL}
union all select target_model, split, group_key, 'action', decision_text, count(*) from n where normalizer_id = 'tagged' group by 1, 2, 3, 5""",
)
def _(t):
    results = t("v_results").withColumnRenamed("group_key", "family_id")
    return SM.family_consistency(results, normalized(t), scores_frame(t)).select("target_model", "split", "family_id", "kind", "name", "n")


@query(
    "A10_slot_sensitivity",
    f"""
with n as (select * from ({NORMALIZED_SQL}) where normalizer_id = 'tagged'),
u as (select target_model, split, 'group' as slot_id, group_key as slot_value, decision_text from n union all select target_model, split, 'run', source_run_id, decision_text from n),
c as (select target_model, split, slot_id, slot_value, decision_text, count(*) as n from u group by 1, 2, 3, 4, 5)
select *, count(*) over (partition by target_model, split, slot_id, slot_value) as distinct_decisions from c""",
)
def _(t):
    slots = F.create_map(F.lit("group"), F.col("group_key"), F.lit("run"), F.col("source_run_id"))
    return SM.slot_sensitivity(t("v_results").withColumn("slot_assignments", slots), normalized(t))


@query(
    "A11_family_action_counts",
    """
with s as (select target_model, case_id, case turn % 4 when 0 then concat(group_key, '|', split) when 1 then split else target_model end as labels,
  case when turn % 4 = 2 then target_model end as action from v_results where turn % 4 <> 3)
select target_model, split, group_key as family_id, 'cases' as kind, '' as name, count(*) as n from v_results group by 1, 2, 3
union all select r.target_model, r.split, r.group_key, 'label', unnest(string_split(s.labels, '|')) as l, count(*) from v_results r join s on r.target_model = s.target_model and r.case_id = s.case_id group by 1, 2, 3, 5
union all select r.target_model, r.split, r.group_key, 'action', s.action, count(*) from v_results r join s on r.target_model = s.target_model and r.case_id = s.case_id where s.action is not null group by 1, 2, 3, 5""",
)
def _(t):
    results = t("v_results").withColumnRenamed("group_key", "family_id")
    scores, _bad = RS.judge_scores(judge_replies(t), t("v_results"), "judge")
    return SM.family_action_counts(results, scores).select("target_model", "split", "family_id", "kind", "name", "n")


# --- annotation bookkeeping, hooks ----------------------------------------------------
@query("J7_unannotated", "select source_run_id, source_record_id from v_results where turn % 4 = 3")
def _(t):
    return RN.unannotated(t("v_results"), annotations_frame(t)).select("source_run_id", "source_record_id")


@query(
    "U3_append_annotations",
    """
select source_run_id, source_record_id, 0 as batch from v_results where turn % 4 <> 3
union all select source_run_id, source_record_id, 1 from v_results where turn % 4 = 3""",
)
def _(t):
    existing = annotations_frame(t)
    new = RN.unannotated(t("v_results"), existing).select("source_run_id", "source_record_id")
    return RN.append_annotations(existing, new).select("source_run_id", "source_record_id", "batch")


@query(
    "X1_register_normalizer",
    """
select source_record_id, length(response_text) as n_chars, null as error from v_results where turn <> 7
union all select source_record_id, null, 'seventh turn' from v_results where turn = 7""",
)
def _(t):
    def measure(row: dict) -> dict:
        if row["turn"] == 7:
            raise ValueError("seventh turn")
        return {"source_record_id": row["source_record_id"], "n_chars": len(row["response_text"])}

    hooks = Hooks()
    hooks.register_normalizer("measure", measure, "source_record_id string, n_chars bigint")
    good, bad = hooks.normalize("measure", t("v_results"))
    return good.select("source_record_id", "n_chars").unionByName(bad.select("source_record_id", "error"), allowMissingColumns=True)


@query("X2_register_scorer", "select source_record_id, 'long' as scorer_id, case when length(response_text) > 300 then 1.0e0 else 0.0e0 end as score from v_results")
def _(t):
    hooks = Hooks()
    hooks.register_scorer("long", lambda df: df.select("source_record_id", (F.char_length("response_text") > 300).cast("double").alias("score")))
    return hooks.score("long", t("v_results"))[0].select("source_record_id", "scorer_id", "score")


@query(
    "X3_register_analyzer",
    """
select r.target_model, r.group_key, count(*) as n, round(max(s.score), 6) as best, 'best' as analyzer_id from v_results r join v_scores s on r.request_id = s.request_id group by 1, 2""",
)
def _(t):
    hooks = Hooks()
    hooks.register_analyzer(
        "best",
        lambda r, s: r.select("request_id", "target_model", "group_key").join(s.select("request_id", "score"), "request_id").groupBy("target_model", "group_key").agg(
            F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best")
        ),
    )
    return hooks.analyze("best", t("v_results"), t("v_scores"))


@query(
    "X4_register_plugin",
    """
select 'per_model' as plugin_id, target_model as key, count(*) as n from v_results group by 2
union all select 'models', 'models', count(distinct target_model) from v_results
union all select 'errors', 'broken', 2""",
)
def _(t):
    def broken(layers, outputs):
        raise RuntimeError("broken plugin")

    hooks = Hooks()
    hooks.register_plugin("after_broken", lambda layers, outputs: outputs["broken"], ("broken",))
    hooks.register_plugin("models", lambda layers, outputs: outputs["per_model"].select(F.lit("models").alias("key")).groupBy("key").agg(F.count("*").alias("n")), ("per_model",))
    hooks.register_plugin("per_model", lambda layers, outputs: layers["results"].groupBy(F.col("target_model").alias("key")).agg(F.count("*").alias("n")))
    hooks.register_plugin("broken", broken)
    outputs, errors = hooks.run_plugins({"results": t("v_results")})
    out = outputs["per_model"].unionByName(outputs["models"])
    failed = t("v_results").agg(F.max(F.lit(len(errors)).cast("bigint")).alias("n")).select(F.lit("broken").alias("key"), "n", F.lit("errors").alias("plugin_id"))
    return out.unionByName(failed)


@query(
    "X5_register_builder",
    """select concat('b_', cast(seq as varchar)) as case_id, 'docs' as source_builder, 'default' as split, 'en' as language, prompt as rendered_input from v_cases where trim(prompt) <> ''""",
)
def _(t):
    hooks = Hooks()
    hooks.register_builder(
        "docs", lambda spark, config, seed: t("v_cases").select(F.concat(F.lit(config["prefix"]), F.col("seq").cast("string")).alias("case_id"), "prompt")
    )
    ok, _bad = hooks.build(t.spark, "docs", {"prefix": "b_"})
    return ok.select("case_id", "source_builder", "split", "language", "rendered_input")


# --- flagship -------------------------------------------------------------------------
FLAG_RULES = [RS.Rule("refuses", "contains_any", ("refuse", "sorry"), ("refusal",)), RS.Rule("picks", "regex_any", (r"<(?:final_)?choice>",), ("choice",))]


@query(
    "E1_flagship",
    """
with n as (select target_model, split, group_key, count(*) as case_count, round(avg(case when turn % 3 = 2 then 1.0e0 else 0.0e0 end), 6) as refusal_rate from v_tagged group by 1, 2, 3),
s as (select target_model, case_id, x.scorer_id, case when x.scorer_id = 'refuses' then case when turn % 3 = 2 then 1.0e0 else 0.0e0 end else case when turn % 3 <> 2 then 1.0e0 else 0.0e0 end end as score
  from v_tagged cross join (select 'refuses' as scorer_id union all select 'picks') x),
j as (select r.target_model, r.split, r.group_key, s.scorer_id, count(*) as score_record_count, round(avg(s.score), 6) as mean_score
  from v_tagged r join s on r.target_model = s.target_model and r.case_id = s.case_id group by 1, 2, 3, 4)
select n.target_model, n.split, n.group_key, j.scorer_id, n.case_count, j.score_record_count, j.mean_score, n.refusal_rate
from n join j on n.target_model = j.target_model and n.split = j.split and n.group_key = j.group_key""",
)
def _(t):
    """Responses -> normalized rows and rule scores -> group summary with refusal rate."""
    results = t("v_tagged")
    norm = RS.normalize_results(results, [RS.Normalizer("builtin")], "reply")
    group = ["target_model", "split", "group_key"]
    rates = norm.groupBy(*group).agg(F.round(F.avg(F.col("refusal_flag").cast("double")), 6).alias("refusal_rate"))
    scores, _failed = RS.rule_scores(results, FLAG_RULES, "reply")
    summary = SM.group_summary(results, scores)
    return summary.join(rates, group).select(
        *group, "scorer_id", "case_count", "score_record_count", F.round(F.try_element_at("scores", F.lit("matched")), 6).alias("mean_score"), "refusal_rate"
    )
