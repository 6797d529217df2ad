"""Queries over sources, validation, selection and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.catalog.views import Tables, query
from benchloom.functions import params as PR
from benchloom.functions import variants as V
from benchloom.functions.failures import categorize_failure
from benchloom.functions.groups import group_value, split_value
from benchloom.functions.template import append_choices
from benchloom.functions.text import infer_language, normalize_text, path_component, slug
from benchloom.operators import cases as C
from benchloom.operators import requests as RQ
from benchloom.operators import summaries as SM
from benchloom.session import scratch_path
from benchloom.sizing import spread_scan
from benchloom.sources import cases as SC
from benchloom.sources import layers as SL
from benchloom.sources import prompts as SP

CJK = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"
NORM = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def cases_frame(t: Tables) -> DataFrame:
    """v_cases in the shape of the case operators."""
    meta = F.parse_json(F.to_json(F.struct("family_id", "quality", "toxic", (F.col("toxic") == 1).alias("flag"))))
    return t("v_cases").select(
        "*",
        meta.alias("metadata"),
        F.create_map(F.lit("lang"), F.col("language")).alias("grouping"),
        F.array(F.concat(F.lit("lang:"), "language"), F.concat(F.lit("q:"), F.col("quality").cast("string"))).alias("tags"),
        F.lit("text").alias("input_modality"),
        F.when(F.col("quality") >= 0, "labelled").alias("source_builder"),
    )


# --- sources --------------------------------------------------------------------------
@query(
    "S1_read_prompts_text",
    rf"""
with x as (select seq, {NORM.format(c="prompt")} as prompt from v_cases)
select concat('prompt_', lpad(cast(row_number() over (order by seq) as varchar), 6, '0')) as prompt_id, prompt,
  case when regexp_matches(prompt, '{CJK}') then 'zh' else 'en' end as language
from x where prompt <> ''""",
)
def _(t):
    path = scratch_path(t.spark, "prompts-txt")
    line = F.regexp_replace("prompt", "\n+", " ")
    t("v_cases").orderBy("seq").select(line.alias("value")).write.text(path)
    return SP.read_prompts_text(t.spark, path).drop("seq")


@query(
    "S2_read_prompts_csv",
    rf"""
with x as (select *, {NORM.format(c="prompt")} as p from v_cases),
k as (select *, row_number() over (order by seq) as n from x where p <> '')
select case when quality = 1 then concat('own_', cast(seq as varchar)) else concat('prompt_', lpad(cast(n as varchar), 6, '0')) end as prompt_id,
  p as prompt, language, case when toxic = 1 then 'blur' end as negative_prompt, seq as seed, family_id as source, 'v1' as version,
  case when toxic = 0 then 'rejected' else 'ok' end as outcome
from k""",
)
def _(t):
    path = scratch_path(t.spark, "prompts-csv")
    meta = F.when(F.col("toxic") == 0, F.lit("[1]")).otherwise(F.to_json(F.struct(F.col("family_id").alias("source"))))
    t("v_cases").orderBy("seq").select(
        F.when(F.col("quality") == 1, F.concat(F.lit("own_"), F.col("seq").cast("string"))).otherwise("").alias("prompt_id"),
        "prompt",
        F.upper("language").alias("language"),
        F.when(F.col("toxic") == 1, " blur ").otherwise("").alias("negative_prompt"),
        F.to_json(F.struct(F.col("seq").alias("seed"), F.col("family_id").alias("source"))).alias("parameters"),
        meta.alias("metadata"),
        F.lit("v1").alias("version"),
    ).write.csv(path, header=True, escape='"', emptyValue="")
    ok, bad = SP.read_prompts_csv(t.spark, path)
    both = ok.withColumn("outcome", F.lit("ok")).unionByName(bad.withColumn("outcome", F.lit("rejected")))
    return both.select(
        "prompt_id", "prompt", "language", "negative_prompt", V.get_number("parameters", "seed").cast("bigint").alias("seed"),
        V.get_text("parameters", "source").alias("source"), "version", "outcome",
    )


@query(
    "S3_read_prompts_jsonl",
    rf"""
select case when toxic = 1 then '' else case_id end as prompt_id, {NORM.format(c="prompt")} as prompt, language, family_id as source,
  case when toxic = 1 then 'missing prompt_id' end as error
from v_cases where quality <> 0
union all select '', '', 'en', null, 'bad json' from v_cases where quality = 0""",
)
def _(t):
    path = scratch_path(t.spark, "prompts-jsonl")
    row = F.to_json(
        F.struct(
            F.when(F.col("toxic") != 1, F.col("case_id")).alias("prompt_id"), "prompt", "language",
            F.struct(F.col("family_id").alias("source")).alias("metadata"),
        )
    )
    line = F.when(F.col("quality") == 0, F.concat(F.lit("{broken "), "case_id")).otherwise(row)
    t("v_cases").select(line.alias("value")).write.text(path)
    ok, bad = SP.read_prompts_jsonl(t.spark, path)
    return ok.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select(
        "prompt_id", "prompt", "language", V.get_text("metadata", "source").alias("source"), "error"
    )


@query(
    "S4_read_cases",
    r"""
select case_id, benchmark_id, split, language, 'image' as input_modality, family_id, case when toxic = 1 then null else prompt end as prompt,
  regexp_replace(case when toxic = 1 then concat('do: ', prompt) else prompt end, '^\s+|\s+$', '', 'g') as rendered_input, 'v2' as case_version
from v_cases""",
)
def _(t):
    path = scratch_path(t.spark, "cases-jsonl")
    t("v_cases").select(
        F.to_json(
            F.struct(
                F.when(F.col("toxic") != 0, F.col("case_id")).alias("case_id"),
                F.when(F.col("toxic") == 0, F.col("case_id")).alias("prompt_id"),
                F.lit("image").alias("input_type"),
                F.when(F.col("toxic") != 1, F.col("prompt")).alias("prompt"),
                F.when(F.col("toxic") == 1, F.concat(F.lit("do: "), "prompt")).alias("instruction"),
                "split",
                "language",
                F.lit("v2").alias("version"),
                F.struct("family_id").alias("metadata"),
            )
        ).alias("value")
    ).write.text(path)
    ok, _bad = SC.read_cases(t.spark, path, "suite", "static_file")
    return ok.select(
        "case_id", "benchmark_id", "split", "language", "input_modality", V.get_text("metadata", "family_id").alias("family_id"),
        "prompt", "rendered_input", "case_version",
    )


@query(
    "S5_read_layer",
    """
select 'ledger' as layer, model_name, status, count(*) as n from v_ledger group by model_name, status""",
)
def _(t):
    root = scratch_path(t.spark, "bundle")
    t("v_ledger").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{root}/ledger")
    rows = SL.read_layer(t.spark, root, "ledger").select(F.lit("ledger").alias("layer"), "model_name", "status")
    absent = SL.read_layer(t.spark, root, "annotations").select(
        F.lit("annotations").alias("layer"), F.col("source_model_name").alias("model_name"), F.col("annotation_status").alias("status")
    )
    return rows.unionByName(absent).groupBy("layer", "model_name", "status").agg(F.count("*").alias("n"))


@query(
    "S6_import_legacy_prompts",
    r"""
with x as (select *, row_number() over (order by seq) as n, regexp_replace(prompt, '^\s+|\s+$', '', 'g') as p from v_cases),
y as (select *, case when toxic = 1 then substr(p, 1, 80) else family_id end as theme from x where p <> '')
select case when quality = 1 then concat('u-', cast(seq as varchar)) when toxic = 0 then concat('legacy_csv_', cast(seq as varchar))
    else concat('legacy_prompt_', lpad(cast(n as varchar), 6, '0')) end as prompt_id,
  p as prompt, case when language in ('en', 'zh') then language else language end as language, 'imported' as category,
  case when split = 'test' then 'imported' else split end as subcategory, language as subtopic, theme,
  concat_ws('>', 'imported', case when split = 'test' then null else split end, language, theme) as theme_path
from y""",
)
def _(t):
    path = scratch_path(t.spark, "legacy-csv")
    t("v_cases").orderBy("seq").select(
        F.when(F.col("toxic") == 0, F.col("seq").cast("string")).otherwise("").alias("idx"),
        F.when(F.col("quality") == 1, F.concat(F.lit("u-"), F.col("seq").cast("string"))).otherwise("").alias("uuid"),
        "prompt",
        F.when(F.col("toxic") == 1, "").otherwise(F.col("family_id")).alias("keyword"),
        F.col("language").alias("class_level_0"),
        F.when(F.col("split") == "test", "").otherwise(F.col("split")).alias("class_level_1"),
        F.lit("t2i").alias("model_type"),
        F.when(F.col("language") == "en", "EN-us").otherwise(F.upper("language")).alias("lang"),
    ).write.csv(path, header=True, escape='"', emptyValue="")
    out = SP.import_legacy_prompts(SP.read_legacy_csv(t.spark, path), "imported")
    return out.select("prompt_id", "prompt", "language", "category", "subcategory", "subtopic", "theme", F.concat_ws(">", "theme_path").alias("theme_path"))


@query(
    "S7_write_layers",
    """
select 'cases' as layer, split as part, count(*) as n from v_cases group by split
union all select 'target_results', target_model, count(*) from v_results group by target_model""",
)
def _(t):
    root = scratch_path(t.spark, "experiment")
    SL.write_layers({"cases": t("v_cases"), "target_results": t("v_results")}, root, {"cases": ["split"], "target_results": ["target_model"]})
    a = t.spark.read.parquet(f"{root}/cases").groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n"))
    b = t.spark.read.parquet(f"{root}/target_results").groupBy(F.col("target_model").alias("part")).agg(F.count("*").alias("n"))
    return a.withColumn("layer", F.lit("cases")).unionByName(b.withColumn("layer", F.lit("target_results")))


@query(
    "S8_write_flat_csv",
    """
select source_record_id as a_record, concat('["', target_model, '","', split, '"]') as b_tags,
  concat('{"turn":', cast(turn as varchar), ',"group":"', group_key, '"}') as c_meta,
  case when turn % 2 = 0 then 'True' else 'False' end as d_even, case when turn % 3 = 0 then null else response_text end as e_text
from v_results""",
)
def _(t):
    path = scratch_path(t.spark, "flat-csv")
    df = t("v_results").select(
        F.when(F.col("turn") % 3 != 0, F.col("response_text")).alias("e_text"),
        F.struct("turn", F.col("group_key").alias("group")).alias("c_meta"),
        F.array("target_model", "split").alias("b_tags"),
        (F.col("turn") % 2 == 0).alias("d_even"),
        F.col("source_record_id").alias("a_record"),
    )
    SL.write_flat_csv(df, path)
    return t.spark.read.csv(path, header=True, multiLine=True, escape='"')


@query(
    "S9_write_dataset",
    """
select case when split = '' then 'unknown' else split end as split, concat('org_', model_name) as model_name,
  replace(artifact_type, '/', '_') as artifact_type, count(*) as n from v_records group by 1, 2, 3""",
)
def _(t):
    path = scratch_path(t.spark, "dataset")
    SL.write_dataset(t("v_records").withColumn("model_name", F.concat(F.lit("org/"), "model_name")), path)
    return t.spark.read.parquet(path).groupBy("split", "model_name", "artifact_type").agg(F.count("*").alias("n"))


@query(
    "S10_read_manifests",
    """
select run_id, cast(max(event_id) as varchar) as created_at, case when max(case when status = 'failed' then 1 else 0 end) = 1 then 'partial' else 'completed' end as status
from v_ledger group by run_id""",
)
def _(t):
    root = scratch_path(t.spark, "runs")
    runs = t("v_ledger").groupBy("run_id").agg(
        F.max("event_id").cast("string").alias("created_at"),
        F.when(F.max((F.col("status") == "failed").cast("int")) == 1, "partial").otherwise("completed").alias("status"),
    )
    good = F.to_json(F.struct("run_id", "created_at", "status"))
    rows = runs.select(F.col("run_id").alias("dir"), good.alias("value")).unionByName(
        runs.select(F.concat(F.lit("broken_"), "run_id").alias("dir"), F.lit("{not json").alias("value"))
    )
    rows.repartition("dir").write.partitionBy("dir").text(root)
    return SL.read_manifests(t.spark, root, "run", "part-*").select("run_id", "created_at", "status")


# --- projections and filters ----------------------------------------------------------
PROMPTS_SQL = """
select seq, case when toxic = 1 then '' else concat('p_', cast(case when split = 'val' then seq - 1 else seq end as varchar(20))) end as prompt_id,
  case when family_id = 'src3' then '' else prompt end as prompt, language from v_cases"""


@query(
    "P1_validate_prompts",
    f"""
with p as ({PROMPTS_SQL}),
q as (select *, min(seq) over (partition by prompt_id) as first_seq from p)
select seq, prompt_id, concat_ws('|', case when prompt_id = '' then 'missing prompt_id' end,
  case when prompt_id <> '' and seq > first_seq then 'duplicate prompt_id' end, case when prompt = '' then 'empty prompt' end,
  case when language not in ('en', 'de', 'fr') then 'unsupported language' end) as errors
from q""",
)
def _(t):
    ok, bad = C.validate_prompts(t.sql(PROMPTS_SQL), ["en", "de", "fr"])
    both = ok.withColumn("errors", F.array().cast("array<string>")).unionByName(bad)
    return both.select("seq", "prompt_id", F.concat_ws("|", "errors").alias("errors"))


PARAMS_SQL = """
select o_orderkey, concat('{"width": ', case when o_orderpriority = '1-URGENT' then 'true' else cast(o_custkey as varchar(20)) end,
  ', "seed": "', cast(o_orderkey as varchar(20)), '", "guidance_scale": "7.5", "stream": "',
  case o_orderstatus when 'F' then 'Yes' when 'O' then 'n' else 'maybe' end, '", "resolution": "',
  case when o_orderpriority = '5-LOW' then 'big' else '1024 x 768' end, '", "mystery": ', cast(o_custkey as varchar(20)), '}') as raw
from orders"""


@query(
    "P2_normalize_params",
    """
select o_orderkey, case when o_orderpriority = '1-URGENT' then null else o_custkey end as width, o_orderkey as seed, 7.5e0 as guidance_scale,
  case o_orderstatus when 'F' then true when 'O' then false end as stream,
  case when o_orderpriority = '5-LOW' then null else '1024 x 768' end as resolution, cast(o_custkey as varchar) as extra,
  concat_ws('|', case when o_orderpriority = '1-URGENT' then 'width: expected integer' end,
    case when o_orderstatus not in ('F', 'O') then 'stream: expected boolean' end,
    case when o_orderpriority = '5-LOW' then 'resolution: expected resolution' end) as errors, 'unknown parameter: mystery' as warnings
from orders""",
)
def _(t):
    # The struct is built once per row; the fields are read from it.
    raw = spread_scan(t.sql(PARAMS_SQL)).select("o_orderkey", F.try_parse_json("raw").alias("v"))
    df = raw.select("o_orderkey", PR.coerce(F.col("v"), ["width", "seed", "guidance_scale", "stream", "resolution"]).alias("p"))
    return df.select(
        "o_orderkey", "p.width", "p.seed", "p.guidance_scale", "p.stream", "p.resolution",
        F.try_element_at("p.extra", F.lit("mystery")).alias("extra"), F.concat_ws("|", "p.errors").alias("errors"), F.concat_ws("|", "p.warnings").alias("warnings"),
    )


@query(
    "P3_normalize_text",
    rf"select doc_id, md5({NORM.format(c='text')}) as digest, length({NORM.format(c='text')}) as n_chars from documents",
)
def _(t):
    n = t("documents").select("doc_id", normalize_text("text").alias("x"))
    return n.select("doc_id", F.md5("x").alias("digest"), F.char_length("x").cast("bigint").alias("n_chars"))


@query(
    "P4_infer_language",
    f"""
with x as (select doc_id, case when lang = 'de' then concat(text, ' 雨中的狗') when lang = 'es' then concat(text, ' ひ') else text end as text from documents)
select doc_id, case when regexp_matches(text, '{CJK}') then 'zh' else 'en' end as language from x""",
)
def _(t):
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit(" 雨中的狗"))).when(F.col("lang") == "es", F.concat("text", F.lit(" ひ"))).otherwise(F.col("text"))
    return t("documents").select("doc_id", infer_language(text).alias("language"))


@query(
    "P5_filter_cases",
    """
select case_id from v_cases where seq in (select doc_id from labels) and split in ('train', 'val')
  and language in ('en', 'fr') and family_id not in ('src1', 'src2')""",
)
def _(t):
    ids = t("labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("case_id"))
    spec = C.Selection(
        group_selector="metadata.family_id", exclude_groups=("src1", "src2"), include_ids=ids, splits=("train", "val"), tags=("lang:en", "lang:fr")
    )
    return C.filter_cases(cases_frame(t), spec).select("case_id")


@query(
    "P6_group_value",
    r"""
select 'all' as selector, 'all' as value, count(*) as n from v_cases
union all select 'case_id_prefix', regexp_replace(case_id, '^(.+)_[0-9]+$', '\1'), count(*) from v_cases group by 2
union all select 'split', split, count(*) from v_cases group by 2
union all select 'metadata.family_id', family_id, count(*) from v_cases group by 2
union all select 'metadata.flag', case when toxic = 1 then 'True' else 'False' end, count(*) from v_cases group by 2
union all select 'metadata.nothing', 'ungrouped', count(*) from v_cases
union all select 'grouping.lang', language, count(*) from v_cases group by 2""",
)
def _(t):
    selectors = ["all", "case_id_prefix", "split", "metadata.family_id", "metadata.flag", "metadata.nothing", "grouping.lang"]
    pairs = F.array(*[F.struct(F.lit(s).alias("selector"), group_value(s).alias("value")) for s in selectors])
    return cases_frame(t).select(F.explode(pairs).alias("p")).groupBy("p.selector", "p.value").agg(F.count("*").alias("n"))


@query(
    "P7_accept_types",
    """
select record_id, artifact_type in ('text', 'video') as accepted,
  case when artifact_type not in ('text', 'video') then concat('artifact_type=', artifact_type, ' is not accepted') end as error_message from v_records""",
)
def _(t):
    ok, bad = C.accept_types(t("v_records"), ["text", "video"])
    return ok.select("record_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("error_message")).unionByName(
        bad.select("record_id", F.lit(False).alias("accepted"), "error_message")
    )


LISTING_SQL = "select distinct concat('/data/', run_id, '/', cast(event_id as varchar(20)), '.bin') as path from v_ledger where status <> 'running' and model_name <> 'model_2'"


@query(
    "P8_exportable",
    f"""
with l as ({LISTING_SQL})
select r.record_id, case when r.model_name = 'model_1' then 'filtered'
  when r.status <> 'success' or trim(r.artifact_path) = '' or l.path is null then 'skipped' else 'exported' end as disposition
from v_records r left join l on trim(r.artifact_path) = l.path""",
)
def _(t):
    return C.exportable(t("v_records"), ["model_0", "model_2"], t.sql(LISTING_SQL)).select("record_id", "disposition")


@query(
    "P9_default_case_fields",
    r"""
select case_id, case when quality = 1 then null else prompt end as prompt, case when quality = 1 then prompt end as instruction,
  regexp_replace(prompt, '^\s+|\s+$', '', 'g') as rendered_input, 'json' as expected_output_contract, 'json' as expected_structure
from v_cases""",
)
def _(t):
    none = F.lit(None).cast("string")
    raw = t("v_cases").select(
        "case_id", "language",
        F.when(F.col("quality") < 0, F.col("prompt")).alias("prompt"),
        none.alias("instruction"),
        F.lit("").alias("context"),
        F.when(F.col("quality") == 0, F.parse_json(F.to_json(F.struct("prompt"))))
        .when(F.col("quality") == 1, F.parse_json(F.to_json(F.struct(F.col("prompt").alias("instruction")))))
        .alias("input_payload"),
        F.when(F.col("toxic") == 1, "json").otherwise("").alias("expected_output_contract"),
        F.when(F.col("toxic") != 1, "json").alias("expected_structure"),
    )
    return SC.default_case_fields(raw).select("case_id", "prompt", "instruction", "rendered_input", "expected_output_contract", "expected_structure")


@query(
    "P10_merge_params",
    """
select o_orderkey, case when o_orderpriority = '1-URGENT' then '64' when o_orderpriority = '2-HIGH' then '99' else '1024' end as width,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then '32' else '768' end as height, cast(o_orderkey as varchar) as seed, '25' as steps,
  case when o_orderstatus = 'F' then 'own' else 'run wide' end as negative
from orders""",
)
def _(t):
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])
    own = (
        F.when(F.col("o_orderpriority") == "1-URGENT", pairs(resolution="64*32", seed=F.col("o_orderkey").cast("string")))
        .when(F.col("o_orderpriority") == "2-HIGH", pairs(width="99", resolution="64 X 32", seed=F.col("o_orderkey").cast("string")))
        .otherwise(pairs(seed=F.col("o_orderkey").cast("string")))
    )
    merged = PR.merge_layers(pairs(width="512", height="512", steps="50", seed="0"), pairs(resolution="1024x768", steps="25"), own)
    df = t("orders").select("o_orderkey", "o_orderstatus", merged.alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    negative = PR.negative_prompt(F.when(F.col("o_orderstatus") == "F", "own").otherwise(""), " run wide ")
    return df.select("o_orderkey", at("width"), at("height"), at("seed"), at("steps"), negative.alias("negative"))


MESSAGE_SQL = """
select event_id, run_id, model_name, status, case event_id % 8 when 0 then 'Conda env missing' when 1 then 'Environment for x is NOT available'
  when 2 then 'worker exited unexpectedly in load_pipeline' when 3 then 'Worker exited unexpectedly' when 4 then 'failed to export frames'
  when 5 then 'boom' when 6 then '' end as error_message from v_ledger"""
CATEGORY_SQL = """case event_id % 8 when 0 then 'env_error' when 1 then 'env_error' when 2 then 'model_load_error' when 3 then 'worker_startup_error'
  when 4 then 'artifact_collection_error' when 5 then 'task_execution_error' else 'unknown_error' end"""


@query("P11_categorize_failure", f"select event_id, {CATEGORY_SQL} as category from v_ledger")
def _(t):
    return t.sql(MESSAGE_SQL).select("event_id", categorize_failure("error_message").alias("category"))


@query(
    "P12_render_prompts",
    r"""
select case_id, regexp_replace(concat('Case ', case_id, ' [', family_id, '] ', prompt, ' '), '^\s+|\s+$', '', 'g') as rendered,
  'allowlisted template variable is unavailable: gone|template variable is unavailable: secret' as warnings from v_cases""",
)
def _(t):
    df = cases_frame(t)
    values = {"case_id": F.col("case_id"), "case.family": V.get_text("metadata", "family_id"), "prompt": F.col("prompt"), "secret": F.lit("x")}
    out = RQ.render_prompts(df, " Case {{ case_id }} [{{case.family}}] {{ prompt }} {{secret}}{{ secret }}", values, ["case_id", "case.family", "prompt", "gone"])
    return out.select("case_id", "rendered", F.concat_ws("|", "warnings").alias("warnings"))


@query(
    "P13_append_choices",
    """
select case_id, case when quality = 0 then prompt
  when quality = 1 then concat(prompt, chr(10), chr(10), 'Choices:', chr(10), 'A. ', language, chr(10), 'B. stay')
  else concat(prompt, chr(10), chr(10), 'Choices:', chr(10), 'A. go', chr(10), 'B. ', family_id) end as prompt from v_cases""",
)
def _(t):
    opt = lambda i, x: F.struct(F.lit(i).alias("id"), (F.lit(x) if isinstance(x, str) else x).alias("text"))
    options = F.when(F.col("quality") == 1, F.array(opt("a", F.col("language")), opt(" B ", "stay"))).when(
        F.col("quality") == 0, F.array(opt("A", "only one"))
    )
    fallback = F.array(opt("A", "go"), opt("B", F.col("family_id")))
    return t("v_cases").select("case_id", append_choices(F.col("prompt"), options, fallback).alias("prompt"))


@query(
    "P14_judge_requests",
    """
select concat('annreq_', source_record_id) as prompt_id, concat('Judge ', target_model, ': ', response_text) as prompt, 'judge_x' as judge_model,
  source_run_id, source_record_id from v_results""",
)
def _(t):
    values = {"target_model": F.col("target_model"), "response": F.col("response_text")}
    out = RQ.judge_requests(t("v_results"), "Judge {{target_model}}: {{response}}", values, list(values), "judge_x")
    return out.select("prompt_id", "prompt", "judge_model", "source.source_run_id", "source.source_record_id")


def _previews(t: Tables, stages: str | None = None) -> DataFrame:
    requests = RQ.expand_requests(t("v_cases"), ["model_0", "model_1", "model_2"], "task").withColumn("rendered_prompt", F.col("prompt"))
    judge = t("v_results").select(
        "case_id", "request_id", "target_model", F.col("response_text").alias("rendered_prompt"), F.lit("judge_x").alias("judge_model"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq")
    )
    return RQ.request_previews(requests, judge, stages)


PREVIEW_SQL = """
select 'target' as stage, x.target_model as entity_id, c.case_id, concat('task:', x.target_model, ':', c.case_id) as request_id, x.target_model,
  c.prompt as rendered_prompt, c.seq from v_cases c cross join v_targets x
union all select 'judge', 'judge_x', case_id, request_id, target_model, response_text, conv_id * 100 + turn from v_results"""


@query("P15_request_previews", PREVIEW_SQL)
def _(t):
    return _previews(t)


@query(
    "W3_first_n_per_stage",
    f"""
with p as ({PREVIEW_SQL}), r as (select *, row_number() over (partition by stage order by seq, request_id) as rn from p)
select stage, request_id, seq from r where rn <= 7""",
)
def _(t):
    return RQ.first_n_per_stage(_previews(t), 7).select("stage", "request_id", "seq")


@query("A13_preview_counts", f"with p as ({PREVIEW_SQL}) select stage, count(*) as n from p group by stage")
def _(t):
    return RQ.preview_counts(_previews(t))


@query(
    "J1_expand_requests",
    "select concat('task:', x.target_model, ':', c.case_id) as request_id, x.target_model, c.case_id, c.split from v_cases c cross join v_targets x",
)
def _(t):
    return RQ.expand_requests(t("v_cases"), ["model_0", "model_1", "model_2"], "task").select("request_id", "target_model", "case_id", "split")


@query(
    "J1_target_table",
    """
select concat('task:customer_', x.c_custkey, ':', c.case_id) as request_id, concat('customer_', x.c_custkey) as target_model, c.case_id
from (select * from v_cases where split = 'test') c, customer x""",
)
def _(t):
    """Over a thousand targets, given as a table."""
    targets = t("customer").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("target_model"))
    return RQ.expand_requests(t("v_cases").where("split = 'test'"), targets, "task").select("request_id", "target_model", "case_id")


# --- selection ------------------------------------------------------------------------
SAMPLE_SQL = """
with r as (select *, row_number() over (partition by family_id order by md5(concat('42:', case_id)), case_id) as rn from v_cases)
select case_id, family_id from r where rn <= 5"""


@query("W1_sample_per_group", SAMPLE_SQL)
def _(t):
    kept, _short = C.sample_per_group(t("v_cases"), F.col("family_id"), 5, 42)
    return kept.select("case_id", "family_id")


@query(
    "W1_undersized_groups",
    """
with g as (select concat(family_id, '/', language) as group_key, count(*) as n from v_cases group by 1)
select group_key, 6 as requested_count, n as actual_count from g where n < 6""",
)
def _(t):
    _kept, short = C.sample_per_group(t("v_cases"), F.concat_ws("/", "family_id", "language"), 6, 42)
    return short


@query("W2_cap_cases", "select case_id from v_cases order by md5(concat('7:cap:', case_id)), case_id limit 25")
def _(t):
    return C.cap_cases(t("v_cases"), 25, 7).select("case_id")


BUNDLE_SQL = """
with f as (select * from v_cases where split = 'train'),
r as (select *, row_number() over (partition by family_id order by md5(concat('42:', case_id)), case_id) as rn from f),
s as (select * from r where rn <= 4 order by md5(concat('42:cap:', case_id)), case_id limit 50)"""


def _bundle(t: Tables) -> C.Sampled:
    spec = C.Selection(group_selector="metadata.family_id", sample_size_per_group=4, splits=("train",), max_cases=50)
    return C.sample_bundle(cases_frame(t), spec, "sampled")


@query(
    "W11_sample_bundle",
    f"{BUNDLE_SQL} select case_id, 'sampled' as benchmark_id, true as selected from s union all select case_id, benchmark_id, false from v_cases where case_id not in (select case_id from s)",
)
def _(t):
    b = _bundle(t)
    return b.selected.select("case_id", "benchmark_id", F.lit(True).alias("selected")).unionByName(
        b.excluded.select("case_id", "benchmark_id", F.lit(False).alias("selected"))
    )


@query(
    "U4_excluded_cases",
    f"{BUNDLE_SQL} select c.family_id as group_key, count(*) as count_before, count(s.case_id) as count_after from v_cases c left join s on c.case_id = s.case_id group by 1",
)
def _(t):
    return _bundle(t).counts


@query(
    "L1_top_examples",
    """
with x as (select family_id as style_family, seq, quality, toxic from v_cases where not (quality >= 0 and toxic = 1)),
r as (select *, row_number() over (partition by style_family order by seq) as rank from x)
select style_family, seq, rank from r where rank <= 3""",
)
def _(t):
    mods = F.when(F.col("quality") < 0, F.array().cast("array<string>")).when(F.col("toxic") == 1, F.array(F.lit("video"))).otherwise(F.array(F.lit("image"), F.lit("video")))
    ex = t("v_cases").select(F.col("family_id").alias("style_family"), "seq", mods.alias("modalities"))
    return RQ.top_examples(ex, "image", 3).select("style_family", "seq", "rank")


# --- case statistics, names -----------------------------------------------------------
@query(
    "A3_case_stats",
    """
select 'input_type' as metric, 'text' as key, count(*) as n from v_cases
union all select 'split', split, count(*) from v_cases group by 2
union all select 'builder', case when quality >= 0 then 'labelled' else 'unknown' end, count(*) from v_cases group by 2
union all select 'family', family_id, count(*) from v_cases group by 2""",
)
def _(t):
    return SM.case_stats(cases_frame(t))


@query(
    "A4_prompt_stats",
    """
select 'category' as metric, split as key, count(*) as n from v_cases group by 2
union all select 'subcategory', family_id, count(*) from v_cases group by 2
union all select 'theme', case when quality >= 0 then language else '' end, count(*) from v_cases group by 2""",
)
def _(t):
    return SM.prompt_stats(
        t("v_cases").select(F.col("split").alias("category"), F.col("family_id").alias("subcategory"), F.when(F.col("quality") >= 0, F.col("language")).alias("theme"))
    )


@query(
    "T15_path_component",
    r"""
select event_id, coalesce(nullif(trim(replace(replace(replace(concat(model_name, '/', run_id, ':', props), '/', '_'), ':', '_'), '\', '_')), ''), 'unknown') as component,
  coalesce(nullif(trim(regexp_replace(lower(concat(' ', model_name, '/', run_id, ' ', event_type, '! ')), '^\s+|\s+$', '', 'g')), ''), 'item') as lowered,
  trim(regexp_replace(lower(trim(concat(' ', model_name, '/', run_id, ' ', event_type, '! '))), '[^a-z0-9]', '_', 'g'), '_') as slug
from (select e.event_id, e.props, e.event_type, l.model_name, l.run_id from events e join v_ledger l on e.event_id = l.event_id)""",
)
def _(t):
    from benchloom.functions.text import strip_ws

    e = t("v_ledger").join(t("events").select("event_id", "props", "event_type"), "event_id")
    raw = F.concat(F.lit(" "), "model_name", F.lit("/"), "run_id", F.lit(" "), "event_type", F.lit("! "))
    return e.select(
        "event_id", path_component(F.concat("model_name", F.lit("/"), "run_id", F.lit(":"), "props")).alias("component"),
        F.lower(strip_ws(raw)).alias("lowered"), slug(raw).alias("slug"),
    )


@query(
    "T19_extract_split",
    """select record_id, case when status = 'success' then 'meta' when split <> '' then split else 'unspecified' end as split from v_records""",
)
def _(t):
    meta = F.when(F.col("status") == "success", F.parse_json(F.lit('{"split": " meta "}'))).otherwise(F.parse_json(F.lit("{}")))
    return t("v_records").select("record_id", split_value(meta, F.col("split")).alias("split"))
