"""Queries over runs, ledgers, batches, budgets and live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.catalog.intake import CATEGORY_SQL, LISTING_SQL, MESSAGE_SQL
from benchloom.catalog.views import Tables, query
from benchloom.operators import cases as C
from benchloom.operators import numbering as N
from benchloom.operators import runs as RN
from benchloom.operators import summaries as SM
from benchloom.session import scratch_path
from benchloom.streaming import ledger as L
from benchloom.streaming.store import Store
from benchloom.streaming.deltas import read_deltas

OUTCOME_SQL = """
with o as (select model_name, prompt_id, max(case status when 'success' then 2 when 'failed' then 1 end) as rank from v_ledger where status in ('success', 'failed') group by 1, 2)"""


# --- recovery -------------------------------------------------------------------------
@query(
    "J6_missing_items",
    f"""{OUTCOME_SQL}
select p.model_name, p.prompt_id, 'resume' as mode from v_planned p left join o on p.model_name = o.model_name and p.prompt_id = o.prompt_id where o.rank is null
union all select p.model_name, p.prompt_id, 'retry' from v_planned p join o on p.model_name = o.model_name and p.prompt_id = o.prompt_id where o.rank = 1""",
)
def _(t):
    a = RN.missing_items(t("v_planned"), t("v_ledger")).withColumn("mode", F.lit("resume"))
    b = RN.failed_items(t("v_planned"), t("v_ledger")).withColumn("mode", F.lit("retry"))
    return a.unionByName(b).select("model_name", "prompt_id", "mode")


@query(
    "J6_failed_tasks",
    """
with f as (select task_id, model_name, prompt_id from v_planned where task_id in (select concat('t', cast(user_id as varchar), '_5') from events where event_type = 'error')),
m as (select model_name, prompt_id, case status when 'success' then 2 when 'failed' then 1 end as rank from v_ledger where status in ('success', 'failed')
  union all select model_name, prompt_id, 1 from f),
o as (select model_name, prompt_id, max(rank) as rank from m group by 1, 2)
select p.model_name, p.prompt_id from v_planned p join o on p.model_name = o.model_name and p.prompt_id = o.prompt_id where o.rank = 1""",
)
def _(t):
    failures = t("events").where("event_type = 'error'").select(F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("_5")).alias("task_id"))
    failed = RN.failed_task_prompts(t("v_planned"), failures)
    return RN.failed_items(t("v_planned"), t("v_ledger"), failed).select("model_name", "prompt_id")


@query(
    "U2_recovery_state",
    f"""{OUTCOME_SQL}
select coalesce(p.model_name, o.model_name) as model_name, coalesce(p.prompt_id, o.prompt_id) as prompt_id,
  case o.rank when 2 then 'success' when 1 then 'failed' else 'missing' end as state, p.model_name is not null as planned
from v_planned p full join o on p.model_name = o.model_name and p.prompt_id = o.prompt_id""",
)
def _(t):
    return RN.recovery_state(t("v_planned"), t("v_ledger"))


@query("J8_with_existing_artifacts", f"select record_id from v_records where artifact_path in ({LISTING_SQL})")
def _(t):
    return C.with_existing_artifacts(t("v_records"), t.sql(LISTING_SQL)).select("record_id")


# --- conditioning, rewrites -----------------------------------------------------------
@query(
    "J9_bind_conditioning",
    """
with a as (select *, row_number() over (partition by model_name, prompt_id order by seq desc) as rn from v_records where status = 'success' and trim(artifact_path) <> ''),
p as (select model_name as target_model, prompt_id, case when model_name = 'model_0' then concat('own/', prompt_id) end as own from v_planned)
select p.target_model, p.prompt_id, coalesce(p.own, a.artifact_path) as path, case when p.own is not null then 'provided' when a.artifact_path is not null then 'generated' end as source,
  case when p.own is not null then concat('prompt_provided_', p.target_model, '_image_', p.prompt_id)
       when a.artifact_path is not null then concat('conditioning_preparation_', p.target_model, '_image_', p.prompt_id) end as artifact_id,
  case when p.own is null and a.artifact_path is null then 'no image conditioning artifact' end as error
from p left join a on a.model_name = p.target_model and a.prompt_id = p.prompt_id and a.rn = 1""",
)
def _(t):
    items = t("v_records").select(
        F.col("model_name").alias("target_model"), "prompt_id", F.lit("").alias("conditioning_type"), "status", "seq",
        F.array(F.struct(F.lit("image").alias("type"), F.col("artifact_path").alias("path"))).alias("artifacts"),
    )
    prompts = t("v_planned").select(
        F.col("model_name").alias("target_model"), "prompt_id", F.lit("").alias("ref_path"),
        F.when(F.col("model_name") == "model_0", F.concat(F.lit("own/"), "prompt_id")).alias("image_path"),
    )
    bound, missing = RN.bind_conditioning(prompts, RN.conditioning_artifacts(items))
    good = bound.select(
        "target_model", "prompt_id", F.col("conditioning_path").alias("path"), F.col("conditioning_source").alias("source"), F.col("conditioning_artifact_id").alias("artifact_id")
    )
    return good.unionByName(missing.select("target_model", "prompt_id", "error"), allowMissingColumns=True)


REWRITE_SQL = """
with r as (select *, row_number() over (partition by model_name, prompt_id order by event_id desc) as rn from v_ledger),
x as (select p.model_name as target_model, p.prompt_id, r.status, r.event_id,
  case when r.status is null then 'rewrite output missing' when r.status <> 'success' then 'batch item status failed'
       when r.event_id % 4 = 0 then 'rewrite output artifacts missing' when r.event_id % 4 = 1 then 'rewrite response empty' end as why
  from v_planned p left join r on r.model_name = p.model_name and r.prompt_id = p.prompt_id and r.rn = 1)"""


def _rewritten(t: Tables) -> DataFrame:
    m = F.col("event_id") % 4
    reply = F.when(m == 1, " ").when(m == 2, F.concat(F.lit('{"rewritten_prompt": " new '), F.col("event_id").cast("string"), F.lit('"}'))).when(
        m == 3, F.concat(F.lit(" plain "), F.col("event_id").cast("string"))
    )
    replies = t("v_ledger").select(F.col("model_name").alias("target_model"), "prompt_id", "status", reply.alias("raw_reply"), F.col("event_id").alias("seq"))
    prompts = t("v_planned").select(F.col("model_name").alias("target_model"), "prompt_id", F.concat(F.lit("old "), "prompt_id").alias("prompt"))
    return RN.apply_rewrites(prompts, replies)


@query(
    "J10_apply_rewrites",
    f"""{REWRITE_SQL}
select target_model, prompt_id, case when why is not null then concat('old ', prompt_id) when event_id % 4 = 2 then concat('new ', cast(event_id as varchar)) else concat('plain ', cast(event_id as varchar)) end as prompt,
  case when why is null then 'rewritten' else 'fallback_original' end as status, why as error, concat('old ', prompt_id) as original from x""",
)
def _(t):
    h = F.get("prompt_rewrite_history", F.lit(0))
    return _rewritten(t).select("target_model", "prompt_id", "prompt", F.col("rewrite_status").alias("status"), F.col("rewrite_error").alias("error"), h["original_prompt"].alias("original"))


@query(
    "J10_rewrite_summary",
    f"""{REWRITE_SQL}
select target_model, count(*) filter (where why is null) as rewritten, count(*) filter (where why is not null) as fallback_original from x group by 1""",
)
def _(t):
    return RN.rewrite_summary(_rewritten(t))


# --- batches to rows ------------------------------------------------------------------


def task_results(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tasks made of ledger rows: a run's events of one user within 64 event ids, as batch items."""
    led = t.sql("select *, concat('task_', run_id, '_', model_name, '_', split_part(prompt_id, '_', 1), '_', cast(cast(floor(event_id / 64) as bigint) as varchar(20))) as task_id from v_ledger")
    n = (F.col("event_id") % 3).cast("int")
    artifact = lambda i: F.struct(F.lit("image").alias("type"), F.concat(F.lit("/a/"), F.col("event_id").cast("string"), F.lit("_"), i.cast("string")).alias("path"))
    artifacts = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), n), artifact)
    item = F.struct(
        "event_id",
        F.struct("prompt_id", "status", F.col("event_id").alias("batch_index"), F.concat(F.lit(" err "), F.col("event_id").cast("string")).alias("error"), artifacts.alias("artifacts")).alias("i"),
    )
    tasks = led.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("x"), F.count_if(F.col("status") == "success").alias("ok"))
    items = F.transform("x", lambda e: e["i"])
    results = tasks.select("task_id", F.when(F.col("ok") > 0, items).otherwise(F.array().cast(RN.ITEM)).alias("batch_items"))
    planned = led.select("task_id", "prompt_id", "model_name").distinct()
    return results, planned


LED_SQL = """
with l as (select *, concat('task_', run_id, '_', model_name, '_', split_part(prompt_id, '_', 1), '_', cast(cast(floor(event_id / 64) as bigint) as varchar(20))) as task_id from v_ledger),
k as (select task_id, count(*) filter (where status = 'success') as ok from l group by 1)"""


@query(
    "J12_flatten_batches",
    f"""{LED_SQL}
select l.task_id, l.prompt_id, l.model_name, 'image' as artifact_type, concat('/a/', cast(l.event_id as varchar), '_', cast(i.i as varchar)) as artifact_path
from l join k on l.task_id = k.task_id cross join (select 0 as i union all select 1) i where k.ok > 0 and l.status = 'success' and i.i < l.event_id % 3""",
)
def _(t):
    results, planned = task_results(t)
    return RN.flatten_batches(results, planned).select("task_id", "prompt_id", "model_name", "artifact_type", "artifact_path")


@query(
    "J13_ledger_from_tasks",
    f"""{LED_SQL}
select l.task_id, l.prompt_id, l.model_name, l.status, l.event_id % 3 as artifact_count, case when l.event_id % 3 > 0 then concat('/a/', cast(l.event_id as varchar), '_0') end as artifact_path,
  case when l.status <> 'success' then concat('err ', cast(l.event_id as varchar)) end as error_message, l.event_id as batch_index
from l join k on l.task_id = k.task_id where k.ok > 0
union all
select distinct l.task_id, l.prompt_id, l.model_name, 'failed', 0, null, 'Task failed before prompt-level outputs were available.', null from l join k on l.task_id = k.task_id where k.ok = 0""",
)
def _(t):
    results, planned = task_results(t)
    return RN.ledger_from_tasks(results, planned).select(
        "task_id", "prompt_id", "model_name", "status", "artifact_count", "artifact_path", "error_message", "batch_index"
    )


# --- numbering, batching --------------------------------------------------------------
@query(
    "W5_number_records",
    """
select concat('rec_', lpad(cast(row_number() over (order by run_id, seq) as varchar), 8, '0')) as record_id, record_id as source_record_id, run_id from v_records""",
)
def _(t):
    return N.number_records(t("v_records"), ["run_id", "seq"]).select("record_id", "source_record_id", "run_id")


BATCH_SQL = """
with a as (select *, lag(signature) over (partition by model_name order by seq) as before, row_number() over (partition by model_name order by seq) as rn from v_tasks),
b as (select *, sum(case when before is null or before <> signature then 1 else 0 end) over (partition by model_name order by seq) as island from a),
c as (select *, row_number() over (partition by model_name, island order by seq) - 1 as pos from b)"""


@query("W6_pack_batches", f"{BATCH_SQL} select model_name, seq, signature, pos % 3 as batch_index, rn - pos % 3 as batch_first from c")
def _(t):
    return N.pack_batches(t("v_tasks"), "model_name", "seq", "signature", N.batch_size(8, 3), block_rows=1000)


@query(
    "W6_batch_table",
    f"""{BATCH_SQL}, d as (select model_name, rn - pos % 3 as batch_first, count(*) as n_rows from c group by 1, 2)
select *, row_number() over (partition by model_name order by batch_first) as batch_no from d""",
)
def _(t):
    packed = N.pack_batches(t("v_tasks"), "model_name", "seq", "signature", 3, block_rows=1000)
    return N.batch_table(packed, "model_name", block_rows=1000)


@query(
    "W7_regroup_by_signature",
    """
select model_name, seq, signature, min(seq) over (partition by model_name, signature) as group_first,
  cast(floor((row_number() over (partition by model_name, signature order by seq) - 1) / 4) as bigint) as group_batch from v_tasks""",
)
def _(t):
    return N.regroup_by_signature(t("v_tasks"), "model_name", "seq", "signature", 4, block_rows=1000)


@query("W8_assign_shards", "select model_name, seq, signature, (row_number() over (partition by model_name order by seq) - 1) % 6 as shard from v_tasks")
def _(t):
    return N.assign_shards(t("v_tasks"), "model_name", "seq", 6, block_rows=1000)


PLAN_SQL = "select run_id, count(*) as planned_total from v_ledger group by run_id"
BREACH_SQL = f"""
with f as (select run_id, ts, event_id, row_number() over (partition by run_id order by ts, event_id) as failed_outputs from v_ledger where status = 'failed'),
p as ({PLAN_SQL}),
b as (select f.run_id, f.ts, f.event_id, f.failed_outputs, f.failed_outputs / cast(p.planned_total as double) as failure_rate,
  row_number() over (partition by f.run_id order by f.ts, f.event_id) as rn
  from f join p on f.run_id = p.run_id where f.failed_outputs > 150 or f.failed_outputs / cast(p.planned_total as double) > 0.12)"""


@query("W10_failure_budget", f"{BREACH_SQL} select run_id, event_id, failed_outputs, round(failure_rate, 6) as failure_rate from b where rn = 1")
def _(t):
    out = RN.failure_budget(t("v_ledger"), t.sql(PLAN_SQL), max_failures=150, max_rate=0.12)
    return out.select("run_id", "event_id", "failed_outputs", F.round("failure_rate", 6).alias("failure_rate"))


@query(
    "W10_rows_within_budget",
    f"{BREACH_SQL} select l.run_id, l.event_id from v_ledger l left join b on l.run_id = b.run_id and b.rn = 1 where b.run_id is null or l.ts < b.ts or (l.ts = b.ts and l.event_id <= b.event_id)",
)
def _(t):
    hits = RN.failure_budget(t("v_ledger"), t.sql(PLAN_SQL), max_failures=150, max_rate=0.12)
    return RN.rows_within_budget(t("v_ledger"), hits).select("run_id", "event_id")


# --- merging, statistics --------------------------------------------------------------
@query(
    "U1_merge_runs",
    """
with u as (select 0 as run_order, r.* from v_records r where run_id = 'run_3' union all select 1, r.* from v_records r where run_id <> 'run_3')
select concat('rec_', lpad(cast(row_number() over (order by run_order, seq) as varchar), 8, '0')) as record_id, record_id as source_record_id, run_id,
  concat('parent_', run_id) as parent_run_id, case when run_order = 0 then 'late' end as note from u""",
)
def _(t):
    rec = t("v_records")
    first = rec.where("run_id = 'run_3'").withColumn("note", F.lit("late"))
    manifests = t("v_ledger").select("run_id").distinct().select(
        "run_id", F.concat(F.lit("parent_"), "run_id").alias("parent_run_id"), F.lit(None).cast("string").alias("source_run_id"), F.lit("retry").alias("recovery_mode")
    )
    merged = RN.merge_runs([first, rec.where("run_id <> 'run_3'")], manifests, ["run_order", "seq"])
    return merged.select("record_id", "source_record_id", "run_id", "source_run_lineage.parent_run_id", "note")


def dispositions(t: Tables) -> DataFrame:
    return C.exportable(t("v_records"), ["model_0", "model_2"], t.sql(LISTING_SQL))


DISP_SQL = f"""
with l as ({LISTING_SQL}),
d as (select r.*, case when r.model_name = 'model_1' then 'filtered' when r.status <> 'success' or trim(r.artifact_path) = '' or l.path is null then 'skipped' else 'exported' end as disposition
  from v_records r left join l on trim(r.artifact_path) = l.path)"""


@query(
    "A7_export_stats",
    f"""{DISP_SQL}, e as (select * from d where disposition = 'exported')
select 'model_name' as metric, model_name as key, count(*) as n from e group by 2 union all select 'split', coalesce(nullif(split, ''), 'unknown'), count(*) from e group by 2
union all select 'artifact_type', artifact_type, count(*) from e group by 2 union all select 'run_id', run_id, count(*) from e group by 2""",
)
def _(t):
    return SM.export_stats(dispositions(t))


@query(
    "A7_source_run_stats",
    f"""{DISP_SQL} select run_id, count(*) filter (where disposition = 'exported') as exported, count(*) filter (where disposition = 'skipped') as skipped,
  count(*) filter (where disposition = 'filtered') as filtered from d group by 1""",
)
def _(t):
    return SM.source_run_stats(dispositions(t))


@query(
    "A8_run_model_summary",
    """
with p as (select model_name, cast(split_part(prompt_id, '_', 2) as bigint) as replica_id, count(distinct task_id) as planned_task_count from v_planned group by 1, 2),
a as (select model_name, event_id % 5 + 1 as replica_id, count(distinct prompt_id) as task_count from v_ledger where status <> 'running' group by 1, 2),
m as (select model_name, count(*) as record_count from v_records where status = 'success' group by 1),
n as (select model_name, count(distinct prompt_id) as model_task_count from v_ledger where status <> 'running' group by 1)
select coalesce(p.model_name, a.model_name) as model_name, coalesce(p.replica_id, a.replica_id) as replica_id, coalesce(planned_task_count, 0) as planned_task_count,
  coalesce(task_count, 0) as task_count, m.record_count, n.model_task_count
from p full join a on p.model_name = a.model_name and p.replica_id = a.replica_id
join m on m.model_name = coalesce(p.model_name, a.model_name) join n on n.model_name = coalesce(p.model_name, a.model_name)""",
)
def _(t):
    planned = t("v_planned").withColumn("replica_id", F.element_at(F.split("prompt_id", "_"), 2).cast("bigint"))
    done = t("v_ledger").where("status <> 'running'").select("model_name", (F.col("event_id") % 5 + 1).alias("replica_id"), F.col("prompt_id").alias("task_id"))
    s = SM.run_model_summary(planned, done, t("v_records").where("status = 'success'"))
    return s.select("model_name", "record_count", F.col("task_count").alias("model_task_count"), F.explode("replicas").alias("r")).select("model_name", "record_count", "model_task_count", "r.*")


@query(
    "A12_failure_rollup",
    f"""
with f as (select run_id, model_name, {CATEGORY_SQL} as category from v_ledger where status = 'failed')
select run_id, model_name, category, count(*) as n from f group by rollup (run_id, model_name, category)""",
)
def _(t):
    return SM.failure_rollup(t.sql(MESSAGE_SQL))


# --- streams --------------------------------------------------------------------------
def _stream(t: Tables, view_columns: dict) -> DataFrame:
    """``events`` as a stream with the given columns, timestamps in UTC."""
    schema = t("events").schema
    raw = L.read_stream(t.spark, t.folder, schema, "events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).select(*[c.alias(n) for n, c in view_columns.items()])


def _late_files(t: Tables) -> str:
    """``events`` in several files, one micro-batch each; half of them hold the first hours of the day, so rows come late."""
    path = scratch_path(t.spark, "late-events")
    half = F.when(F.hour(F.col("ts").cast("timestamp")) < 12, "b").otherwise("a")
    salt = F.pmod(F.xxhash64("event_id"), F.lit(4))
    t("events").withColumns({"half": half, "salt": salt}).repartition("half", "salt").write.partitionBy("half", "salt").parquet(path)
    return path


def _late_stream(t: Tables, view_columns: dict) -> DataFrame:
    raw = L.read_stream(t.spark, _late_files(t), t("events").schema, files_per_batch=1)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).select(*[c.alias(n) for n, c in view_columns.items()])


def _stored(t: Tables, columns: dict, fold, merge, files=None) -> DataFrame:
    """A stream of several files through ``fold`` into a store that is merged every third batch."""
    base = scratch_path(t.spark, "store")
    rows = (files or _late_stream)(t, columns)
    store = Store(t.spark, f"{base}/out", fold(rows).schema)
    _run(L.stream_to_store(rows, fold, merge, store, f"{base}/cp", 3, available_now=True))
    return store.read()


def _id(prefix: str, n):
    return F.concat(F.lit(prefix), n.cast("string"))


def _ledger_columns() -> dict:
    e = F.col("event_type")
    return {
        "event_id": F.col("event_id"), "ts": F.col("ts"), "run_id": _id("run_", F.col("user_id") % 5), "model_name": _id("model_", F.col("user_id") % 3),
        "prompt_id": F.concat(_id("p", F.col("user_id")), F.lit("_"), (F.col("event_id") % 5).cast("string")),
        "status": F.when(e == "error", "failed").when(e == "purchase", "success").otherwise("running"),
    }


def _run(query_) -> None:
    query_.awaitTermination()


@query("R1_ledger_sink", "select event_id, run_id, model_name, prompt_id, status from v_ledger")
def _(t):
    """Every row is delivered twice; the ledger shows one."""
    base = scratch_path(t.spark, "r1")
    rows = _stream(t, _ledger_columns())
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    _run(L.ledger_sink(twice, f"{base}/out", f"{base}/cp", available_now=True))
    return L.ledger_rows(read_deltas(t.spark, f"{base}/out"), ["run_id", "event_id"]).select("event_id", "run_id", "model_name", "prompt_id", "status")


@query("R1_ledger_sink_late_files", "select event_id, run_id, model_name, prompt_id, status from v_ledger")
def _(t):
    """Rows that come hours late in later micro-batches are in the ledger like any other."""
    base = scratch_path(t.spark, "r1l")
    _run(L.ledger_sink(_late_stream(t, _ledger_columns()), f"{base}/out", f"{base}/cp", available_now=True))
    return L.ledger_rows(read_deltas(t.spark, f"{base}/out"), ["run_id", "event_id"]).select("event_id", "run_id", "model_name", "prompt_id", "status")


@query("R1_ledger_store", "select event_id, run_id, model_name, prompt_id, status from v_ledger")
def _(t):
    """Late rows, delivered twice, in a store that is merged between batches."""
    keys = ["run_id", "event_id"]
    twice = lambda t, columns: _late_stream(t, columns).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    rows = _stored(t, _ledger_columns(), lambda batch: batch, L.ledger_merge(keys), twice)
    return L.ledger_rows(rows, keys).select("event_id", "run_id", "model_name", "prompt_id", "status")


@query("R2_state_store", f"{OUTCOME_SQL} select model_name, prompt_id, case rank when 2 then 'success' else 'failed' end as state from o")
def _(t):
    return L.ledger_state(_stored(t, _ledger_columns(), RN.key_outcomes, L.state_merge))


@query("R2_ledger_state", f"{OUTCOME_SQL} select model_name, prompt_id, case rank when 2 then 'success' else 'failed' end as state from o")
def _(t):
    base = scratch_path(t.spark, "r2")
    _run(L.stream_ledger_state(_stream(t, _ledger_columns()), f"{base}/out", f"{base}/cp", available_now=True))
    return L.ledger_state(read_deltas(t.spark, f"{base}/out"))


RATES_SQL = """
with w as (select time_bucket(interval '1 hour', ts) as window_start, run_id, model_name, status from v_ledger where status in ('success', 'failed'))
select strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, run_id, model_name, count(*) as processed, count(*) filter (where status = 'success') as succeeded,
  count(*) filter (where status = 'failed') as failed, round_even(count(*) / 60.0e0, 3) as rate_per_min from w group by 1, 2, 3"""


@query("R3_throughput", RATES_SQL)
def _(t):
    return _rates(t, _stream)


@query("R3_throughput_store", RATES_SQL)
def _(t):
    by = ["run_id", "model_name"]
    rows = L.merge_throughput(_stored(t, _ledger_columns(), lambda batch: L.throughput_fold(batch, by), L.throughput_merge(by)), by)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *by, "processed", "succeeded", "failed", "rate_per_min")


@query("R3_throughput_late_files", RATES_SQL)
def _(t):
    return _rates(t, _late_stream)


def _rates(t: Tables, source) -> DataFrame:
    base = scratch_path(t.spark, "r3")
    by = ["run_id", "model_name"]
    _run(L.stream_throughput(source(t, _ledger_columns()), f"{base}/out", f"{base}/cp", by, available_now=True))
    rows = L.merge_throughput(read_deltas(t.spark, f"{base}/out"), by)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *by, "processed", "succeeded", "failed", "rate_per_min")


@query(
    "R3_throughput_sliding",
    """
with e as (select ts, run_id, status, unnest([0, 1]) as k from v_ledger where status in ('success', 'failed')),
w as (select time_bucket(interval '30 minutes', ts) - k * interval '30 minutes' as window_start, run_id, status from e)
select strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, run_id, count(*) as processed, round_even(count(*) / 60.0e0, 3) as rate_per_min from w group by 1, 2""",
)
def _(t):
    rows = L.throughput(t("v_ledger").withColumn("ts", F.col("ts").cast("timestamp")), ["run_id"], "1 hour", "30 minutes")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "run_id", "processed", "rate_per_min")


@query(
    "R3_throughput_snapshot",
    """
with f as (select run_id, count(*) as processed, count(*) filter (where status = 'success') as succeeded, count(*) filter (where status = 'failed') as failed,
  epoch_us(min(ts)) as a, epoch_us(max(ts)) as b from v_ledger where status in ('success', 'failed') group by 1),
p as (select run_id, count(*) as total from v_ledger group by 1),
r as (select f.*, p.total, (b - a) / 1000000.0e0 as sec from f join p on f.run_id = p.run_id)
select run_id, processed, succeeded, failed, round_even(processed / (sec / 60.0e0), 3) as rate_per_min,
  case when total > processed then cast(round_even((total - processed) / (processed / (sec / 60.0e0)) * 60.0e0, 0) as bigint) end as eta_sec from r""",
)
def _(t):
    base = scratch_path(t.spark, "r3s")
    fold = lambda batch: L.progress_fold(batch, ["run_id"])
    _run(L.stream_deltas(_stream(t, _ledger_columns()), fold, f"{base}/out", f"{base}/cp", available_now=True))
    totals = t("v_ledger").groupBy("run_id").agg(F.count("*").alias("total"))
    merged = L.merge_progress(read_deltas(t.spark, f"{base}/out"), ["run_id"])
    return L.throughput_snapshot(merged, totals, ["run_id"])


@query("R4_budget_monitor", f"{BREACH_SQL} select run_id, event_id, failed_outputs, round(failure_rate, 6) as failure_rate from b where rn = 1")
def _(t):
    base = scratch_path(t.spark, "r4")
    plan = t.sql(PLAN_SQL)
    _run(L.budget_monitor(_stream(t, _ledger_columns()), plan, f"{base}/out", f"{base}/cp", 150, 0.12, available_now=True))
    return read_deltas(t.spark, f"{base}/out/alerts").select("run_id", "event_id", "failed_outputs", F.round("failure_rate", 6).alias("failure_rate"))


ANNOTATE_SQL = "select distinct run_id as source_run_id, prompt_id as source_record_id from v_ledger where prompt_id not in (select prompt_id from v_ledger where status = 'success' and model_name = 'model_1')"


@query("R5_incremental_annotation", ANNOTATE_SQL)
def _(t):
    return _handed_out(t, _stream)


@query("R5_annotation_late_files", ANNOTATE_SQL)
def _(t):
    """Keys come again in later batches; the store of those handed out is merged in between."""
    return _handed_out(t, _late_stream)


def _handed_out(t: Tables, source) -> DataFrame:
    base = scratch_path(t.spark, "r5")
    cols = _ledger_columns()
    records = source(t, {"source_run_id": cols["run_id"], "source_record_id": cols["prompt_id"], "event_id": F.col("event_id")})
    done = t("v_ledger").where("status = 'success' and model_name = 'model_1'").select(F.col("run_id").alias("source_run_id"), F.col("prompt_id").alias("source_record_id"))
    _run(L.incremental_annotation(records, done, f"{base}/out", f"{base}/cp", compact_every=3, available_now=True))
    return read_deltas(t.spark, f"{base}/out").select("source_run_id", "source_record_id")


STAGE_SQL = """
with a as (select experiment_id, stage, min(case when status = 'started' then ts end) as s, max(case when status in ('completed', 'failed') then ts end) as e,
  count(*) filter (where status = 'failed') as n_failed from v_log group by 1, 2)
select a.experiment_id, a.stage, coalesce(l.status, 'open') as status, round((epoch_us(a.e) - epoch_us(a.s)) / 1000000.0e0, 6) as duration_sec, a.n_failed
from a left join v_log l on l.experiment_id = a.experiment_id and l.stage = a.stage and l.ts = a.e and l.status in ('completed', 'failed')"""


def _log_columns() -> dict:
    e = F.col("event_type")
    return {
        "event_id": F.col("event_id"), "ts": F.col("ts"), "experiment_id": _id("exp_", F.col("user_id") % 11), "stage": _id("stage_", F.col("event_id") % 4),
        "status": F.when(e == "view", "started").when(e == "purchase", "completed").when(e == "error", "failed").otherwise("note"),
    }


@query("R6_stage_durations", STAGE_SQL)
def _(t):
    base = scratch_path(t.spark, "r6")
    _run(L.stream_deltas(_stream(t, _log_columns()), L.stage_fold, f"{base}/out", f"{base}/cp", available_now=True))
    rows = L.merge_stages(read_deltas(t.spark, f"{base}/out"))
    return rows.select("experiment_id", "stage", "status", F.round("duration_sec", 6).alias("duration_sec"), "n_failed")


@query(
    "R6_stage_runs",
    """
with e as (select *, sum(case when status = 'started' then 1 else 0 end) over (partition by experiment_id, stage order by ts, event_id) as run_no from v_log where status in ('started', 'completed', 'failed')),
a as (select experiment_id, stage, run_no, min(case when status = 'started' then {'ts': ts, 'id': event_id} end) as s,
  max(case when status <> 'started' then {'ts': ts, 'id': event_id, 'status': status} end) as e, count(*) filter (where status = 'failed') as n_failed from e group by 1, 2, 3)
select experiment_id, stage, cast(run_no as bigint) as run_no, coalesce(e.status, 'open') as status, round((epoch_us(e.ts) - epoch_us(s.ts)) / 1000000.0e0, 6) as duration_sec, n_failed,
  cast(coalesce(e.id, s.id) % 100 as bigint) as item_count, case when s.id is not null then cast(s.id % 7 as bigint) end as worker_count from a""",
)
def _(t):
    """Every time a stage ran, with the counts of its payloads, from late files through a store."""
    cols = _log_columns()
    counts = lambda *names: F.to_json(F.struct(*[v.alias(n) for n, v in names]))
    item = ("item_count", F.col("event_id") % 100)
    cols["payload"] = F.when(cols["status"] == "started", counts(item, ("worker_count", F.col("event_id") % 7), ("note", F.lit("begins")))).otherwise(counts(item))
    rows = L.stage_runs(_stored(t, cols, L.stage_events, lambda events: events.distinct()))
    return rows.select(
        "experiment_id", "stage", "run_no", "status", F.round("duration_sec", 6).alias("duration_sec"), "n_failed",
        F.col("counts")["item_count"].alias("item_count"), F.col("counts")["worker_count"].alias("worker_count"),
    )


@query(
    "R7_stage_progress",
    """
with p as (select experiment_id, count(*) as n_requests from v_log group by 1),
f as (select experiment_id, count(*) as processed, count(*) filter (where status = 'failed') as failed, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0e0 as sec
  from (select experiment_id, ts, case status when 'completed' then 'success' else status end as status from v_log) where status in ('success', 'failed') group by 1),
r as (select p.experiment_id, p.n_requests * 4 + 2 as units, f.processed, f.failed, f.processed / (f.sec / 60.0e0) as rate from p join f on p.experiment_id = f.experiment_id)
select experiment_id, units, processed, failed, round_even(rate, 1) as rate_per_min, cast(round_even((units - processed) / rate * 60.0e0, 0) as bigint) as eta_sec from r""",
)
def _(t):
    base = scratch_path(t.spark, "r7")
    cols = _log_columns()
    cols["status"] = F.when(cols["status"] == "completed", "success").otherwise(cols["status"])
    fold = lambda batch: L.progress_fold(batch, ["experiment_id"])
    _run(L.stream_deltas(_stream(t, cols), fold, f"{base}/out", f"{base}/cp", available_now=True))
    merged = L.merge_progress(read_deltas(t.spark, f"{base}/out"), ["experiment_id"])
    plan = t("v_log").groupBy("experiment_id").agg(F.count("*").alias("n_requests"))
    return L.stage_progress(merged, plan, normalizers=2, scorers=1, plugins=2)
