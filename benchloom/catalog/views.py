"""Views over the driver's tables, valid as written in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from benchloom.sizing import broadcast_if_small, spread_scan

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]

VIEWS = {
    "v_cases": """
select concat('doc_', cast(d.doc_id as varchar(20))) as case_id, 'suite' as benchmark_id, d.text as prompt, d.lang as language,
  case when d.doc_id % 10 = 0 then 'test' when d.doc_id % 10 = 1 then 'val' else 'train' end as split,
  d.source as family_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic, d.doc_id as seq
from documents d left join labels l on d.doc_id = l.doc_id""",
    "v_targets": "select 'model_0' as target_model union all select 'model_1' union all select 'model_2'",
    "v_results": """
select concat('rec_', cast(conv_id as varchar(20)), '_', cast(turn as varchar(20))) as source_record_id,
  concat('req_', cast(conv_id as varchar(20)), '_', cast(turn as varchar(20))) as request_id,
  concat('run_', cast(conv_id % 3 as varchar(20))) as source_run_id, concat('model_', cast(conv_id % 3 as varchar(20))) as target_model,
  concat('conv_', cast(conv_id as varchar(20))) as case_id, case when conv_id % 5 = 0 then 'test' else 'train' end as split,
  concat('fam_', cast(conv_id % 7 as varchar(20))) as group_key, conv_id, turn, text as response_text
from conversations where role = 'assistant'""",
    "v_tagged": """
select *, concat('<thinking>', response_text, '</thinking>',
  case when turn % 3 = 0 then '<choice>option a</choice>' when turn % 3 = 1 then '<final_choice> B </final_choice>'
       else 'sorry, I refuse. confidence: 0.4' end) as reply
from v_results""",
    "v_scores": """
select r.source_run_id, r.source_record_id, r.request_id, r.target_model, r.case_id, s.scorer_id, s.score_name,
  case when s.scorer_id = 'len' then cast(length(r.response_text) as double) / 500.0e0 else cast(r.turn as double) end as score,
  case when r.turn % 2 = 0 then 'even' else 'odd' end as label
from v_results r cross join (select 'len' as scorer_id, 'short' as score_name union all select 'turn', 'depth') s""",
    "v_planned": """
select distinct concat('model_', cast(user_id % 3 as varchar(20))) as model_name,
  concat('p', cast(user_id as varchar(20)), '_', cast(k as varchar(20))) as prompt_id,
  concat('t', cast(user_id as varchar(20)), '_', cast(k as varchar(20))) as task_id
from events cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) x""",
    "v_ledger": """
select event_id, ts, concat('run_', cast(user_id % 5 as varchar(20))) as run_id, concat('model_', cast(user_id % 3 as varchar(20))) as model_name,
  concat('p', cast(user_id as varchar(20)), '_', cast(event_id % 5 as varchar(20))) as prompt_id,
  case event_type when 'error' then 'failed' when 'purchase' then 'success' else 'running' end as status
from events""",
    "v_nodes": """
select r.r_name as category, n.n_name as subcategory, c.c_mktsegment as theme, count(*) as n_leaves
from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
group by r.r_name, n.n_name, c.c_mktsegment""",
    "v_tasks": "select o_orderkey as seq, o_orderstatus as model_name, o_orderpriority as signature from orders",
    "v_prompt_texts": "select doc_id as seq, text as prompt from documents",
    # Rows the export and recovery operators work on: ledger rows with an artifact.
    "v_records": """
select concat('rec_', cast(event_id as varchar(20))) as record_id, run_id, model_name, prompt_id, status, event_id as seq,
  case when event_id % 4 = 0 then 'image/png' when event_id % 4 = 1 then 'text' else 'video' end as artifact_type,
  case when event_id % 6 = 0 then ' ' else concat('/data/', run_id, '/', cast(event_id as varchar(20)), '.bin') end as artifact_path,
  case when event_id % 8 = 0 then '' when event_id % 8 < 3 then 'test' else 'train' end as split
from v_ledger""",
    "v_log": """
select event_id, ts, concat('exp_', cast(user_id % 11 as varchar(20))) as experiment_id,
  concat('stage_', cast(event_id % 4 as varchar(20))) as stage,
  case event_type when 'view' then 'started' when 'purchase' then 'completed' when 'error' then 'failed' else 'note' end as status
from events""",
}


def expand(sql: str) -> str:
    """``sql`` with the views it names, directly or through one another, as leading CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name) if name not in needed else None

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"


class Tables:
    """Base tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, small: tuple[str, ...] = ()) -> DataFrame:
        """Table or view ``name``; the base tables ``small`` of a view are broadcast as long as they are."""
        if name in VIEWS:
            return self.sql(f"select * from {name}", small)
        scan = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread_scan(scan) if name in WIDE else scan

    def sql(self, text: str, small: tuple[str, ...] = ()) -> DataFrame:
        full = expand(text)
        for name in BASE:
            if re.search(rf"\b{name}\b", full):
                table = broadcast_if_small(self(name), SMALL_ROWS) if name in small else self(name)
                table.createOrReplaceTempView(name)
        return self.spark.sql(full)


# Tables whose rows are costly to process; the driver writes each as a single split.
WIDE = ("documents", "conversations")
# Rows of a few numbers each up to which a table meets wide rows without their shuffle.
SMALL_ROWS = 1_000_000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under ``name`` with its SQL, if it has one."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = expand(oracle)
        return fn

    return register
