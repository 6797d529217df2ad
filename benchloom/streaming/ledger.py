"""The run ledger and the experiment log, followed live.

Each measure is one function on DataFrames that serves a batch table and a stream alike,
plus a ``stream_…`` function that runs it continuously.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from benchloom.functions.variants import numeric_map, parse_object
from benchloom.operators.keyed import first_wins
from benchloom.operators.runs import KEY, breach_rank, key_outcomes, unannotated
from benchloom.streaming.deltas import Fold, start, stream_deltas
from benchloom.streaming.store import Store

COMPACT_EVERY = 8  # micro-batches
BUCKETS = 64


def stream_to_store(stream: DataFrame, fold: Fold, merge: Fold, store: Store, checkpoint: str, compact_every: int = COMPACT_EVERY, **trigger) -> StreamingQuery:
    """Writes ``fold(batch)`` per micro-batch and compacts the store with ``merge`` from time to time."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.write_batch(fold(batch), batch_id)
        if (batch_id + 1) % compact_every == 0:
            store.compact(merge, least=compact_every - 1)

    return start(stream.writeStream.foreachBatch(sink), checkpoint, **trigger)


# --- R1 -------------------------------------------------------------------------------
def ledger_sink(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends every row, however late it comes, one folder per micro-batch; a replayed batch overwrites its own."""
    return stream_deltas(stream, lambda batch: batch, path, checkpoint, **trigger)


def ledger_rows(written: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger as written by ``ledger_sink``: of a redelivered row, the one that came first."""
    return first_wins(written, keys, ["batch"]).select(*[c for c in written.columns if c != "batch"])


def ledger_merge(keys: list[str]) -> Fold:
    """Of a redelivered row the one that came first, with its batch; for a store of ``ledger_sink`` rows."""
    return lambda rows: first_wins(rows, keys, ["batch"])


# --- R2 -------------------------------------------------------------------------------
def stream_ledger_state(ledger: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Best rank per (model, prompt) and batch; success absorbs failure in any order."""
    return stream_deltas(ledger, key_outcomes, path, checkpoint, **trigger)


def state_merge(deltas: DataFrame) -> DataFrame:
    """Ranks of several batches as one, for a store of ``key_outcomes``."""
    return deltas.groupBy(*KEY).agg(F.max("rank").alias("rank"))


def ledger_state(deltas: DataFrame) -> DataFrame:
    best = deltas.groupBy(*KEY).agg(F.max("rank").alias("rank"))
    return best.select(*KEY, F.when(F.col("rank") == 2, "success").otherwise("failed").alias("state"))


# --- R3 -------------------------------------------------------------------------------
def _done(name: str = "status") -> tuple[Column, Column]:
    return F.count_if(F.col(name) == "success"), F.count_if(F.col(name) == "failed")


def throughput_fold(ledger: DataFrame, by: list[str], window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mergeable counts per window, tumbling or sliding with ``slide``."""
    ok, bad = _done()
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = ledger.where(F.col("status").isin("success", "failed")).groupBy(w.alias("w"), *by).agg(ok.alias("succeeded"), bad.alias("failed"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "succeeded", "failed")


def merge_throughput(folds: DataFrame, by: list[str]) -> DataFrame:
    """Per window: processed, succeeded, failed and the rate per minute (3 decimals, half-even)."""
    agg = folds.groupBy("window_start", "window_end", *by).agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))
    minutes = (F.unix_micros("window_end") - F.unix_micros("window_start")) / F.lit(60_000_000)
    done = F.col("succeeded") + F.col("failed")
    return agg.select("window_start", "window_end", *by, done.alias("processed"), "succeeded", "failed", F.bround(done / minutes, 3).alias("rate_per_min"))


def throughput_merge(by: list[str]) -> Fold:
    """Counts of several batches as one, for a store of ``throughput_fold`` rows."""
    return lambda folds: folds.groupBy("window_start", "window_end", *by).agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))


def throughput(ledger: DataFrame, by: list[str], window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Batch form of the same measure."""
    return merge_throughput(throughput_fold(ledger, by, window, slide), by)


def stream_throughput(ledger: DataFrame, path: str, checkpoint: str, by: list[str], window: str = "1 hour", slide: str | None = None, **trigger) -> StreamingQuery:
    """Counts per window and batch; read with ``merge_throughput``.  Late rows count whenever they come."""
    return stream_deltas(ledger, lambda batch: throughput_fold(batch, by, window, slide), path, checkpoint, **trigger)


def progress_fold(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable counters: rows and tasks by outcome, first and last time."""
    ok, bad = _done()
    task = [F.count_if(F.col("task_status") == s).alias(f"tasks_{s}") for s in ("success", "failed")] if "task_status" in ledger.columns else []
    return ledger.where(F.col("status").isin("success", "failed")).groupBy(*by).agg(
        ok.alias("succeeded"), bad.alias("failed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *task
    )


def merge_progress(folds: DataFrame, by: list[str]) -> DataFrame:
    sums = [c for c in folds.columns if c in ("succeeded", "failed") or c.startswith("tasks_")]
    return folds.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def rate_and_eta(processed: Column, total: Column, elapsed_sec: Column, decimals: int = 3) -> tuple[Column, Column]:
    """(rate per minute, ETA in seconds); the ETA is null when nothing is processed or left."""
    rate = F.when((processed > 0) & (elapsed_sec > 0), processed / (elapsed_sec / 60.0)).otherwise(F.lit(0.0))
    left = F.greatest(total - processed, F.lit(0))
    eta = F.when((processed > 0) & (left > 0) & (rate > 0), F.bround(left / rate * 60.0, 0).cast("bigint"))
    return F.bround(rate, decimals), eta


def throughput_snapshot(progress: DataFrame, totals: DataFrame, by: list[str], starts: DataFrame | None = None) -> DataFrame:
    """Rate and ETA per key over the whole run so far.

    Elapsed is last event minus run start; the start comes from ``starts`` (by, started_at)
    when given, else from the first event.
    """
    joined = progress.join(totals.select(*by, "total"), by, "left")
    begin = F.col("first_ts")
    if starts is not None:
        joined = joined.join(starts.select(*by, "started_at"), by, "left")
        begin = F.coalesce("started_at", "first_ts")
    elapsed = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / F.lit(1_000_000)
    done = F.col("succeeded") + F.col("failed")
    rate, eta = rate_and_eta(done, F.coalesce("total", F.lit(0)), F.greatest(elapsed, F.lit(0)))
    return joined.select(*by, done.alias("processed"), "succeeded", "failed", rate.alias("rate_per_min"), eta.alias("eta_sec"))


# --- R4 -------------------------------------------------------------------------------
_BUDGET = "run_id string, failed bigint, last_ts timestamp, bucket int"


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _touched(rows: DataFrame) -> list[int]:
    """The buckets that occur, at most ``BUCKETS`` of them."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def budget_merge(ttl: str | None = None) -> Fold:
    """Failure counts of several batches as one; with ``ttl`` runs without a failure for that long before the newest are let go."""

    def merge(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("run_id", "bucket").agg(F.sum("failed").alias("failed"), F.max("last_ts").alias("last_ts"))
        if ttl is None:
            return sums
        newest = rows.agg((F.max("last_ts") - F.expr(f"interval {ttl}")).alias("from"))
        return sums.join(F.broadcast(newest), F.col("last_ts") >= F.col("from")).drop("from")

    return merge


def budget_monitor(
    ledger: DataFrame, planned: DataFrame, path: str, checkpoint: str, max_failures: int | None = None, max_rate: float | None = None,
    ttl: str | None = None, compact_every: int = COMPACT_EVERY, **trigger,
) -> StreamingQuery:
    """One alert per run, at the row that first breaches the budget.

    A batch is folded to counts before anything is shuffled.  The state is a store of failure
    counts per run and batch, partitioned by a hash of the run: a batch adds its own counts and
    reads those buckets that its runs fall in, and merging keeps their files few.  Only a run
    that crosses its limit in this batch has its rows numbered, in time blocks.  With ``ttl``
    (``"30 days"``) a run without a failure for that long counts from zero again.  Alerts land
    in ``path/alerts``, counts in ``path/counts``.
    """
    counts = Store(ledger.sparkSession, f"{path}/counts", _BUDGET, "bucket")
    alerts = Store(ledger.sparkSession, f"{path}/alerts", "run_id string, ts timestamp, event_id bigint, failed_outputs bigint, failure_rate double")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        failed = batch.where(F.col("status") == "failed").groupBy("run_id").agg(F.count("*").alias("failed"), F.max(F.col("ts").cast("timestamp")).alias("last_ts"))
        failed = failed.withColumn("bucket", _bucket("run_id")).persist()
        before = counts.read(before=batch_id).where(F.col("bucket").isin(_touched(failed))).groupBy("run_id").agg(F.sum("failed").alias("so_far"))
        limits = planned.select("run_id", "planned_total", breach_rank(F.col("planned_total"), max_failures, max_rate).alias("at"))
        state = failed.join(before, "run_id", "left").join(limits, "run_id", "left").withColumns(
            {"so_far": F.coalesce("so_far", F.lit(0)), "at": F.coalesce("at", breach_rank(F.lit(0), max_failures, max_rate)), "planned_total": F.coalesce("planned_total", F.lit(0))}
        )
        crossing = state.where((F.col("so_far") < F.col("at")) & (F.col("so_far") + F.col("failed") >= F.col("at"))).select(
            "run_id", "planned_total", "so_far", F.col("at").alias("full_at")
        )
        rows = batch.join(crossing.select("run_id"), "run_id", "left_semi")
        alerts.write_batch(_nth_failure(rows, crossing), batch_id)
        counts.write_batch(failed, batch_id)
        if (batch_id + 1) % compact_every == 0:
            counts.compact(budget_merge(ttl), least=compact_every - 1)
        failed.unpersist()
        batch.unpersist()

    return start(ledger.writeStream.foreachBatch(sink), checkpoint, **trigger)


def _nth_failure(rows: DataFrame, crossing: DataFrame) -> DataFrame:
    from benchloom.operators.numbering import blockwise_row_number

    failed = rows.where(F.col("status") == "failed").select("run_id", "ts", "event_id")
    block = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    numbered = blockwise_row_number(failed, ["run_id"], ["ts", "event_id"], block, "n").join(crossing, "run_id")
    total = F.col("n") + F.col("so_far")
    rate = F.when(F.col("planned_total") > 0, total / F.col("planned_total")).otherwise(0.0)
    return numbered.where(total == F.col("full_at")).select("run_id", "ts", "event_id", total.alias("failed_outputs"), rate.alias("failure_rate"))


# --- R5 -------------------------------------------------------------------------------
def incremental_annotation(
    records: DataFrame, annotations: DataFrame, path: str, checkpoint: str, keys: list[str] = ("source_run_id", "source_record_id"),
    compact_every: int = COMPACT_EVERY, **trigger,
) -> StreamingQuery:
    """Arriving records that are not annotated, each key once over the life of the stream; they land in ``path``.

    The keys handed out stand in a store below ``path``, partitioned by a hash of the first key
    column (the run): a batch reads the buckets of its own runs and adds its own keys, so what it
    reads follows the runs that are live, not the history.  Finished annotations are reduced to
    the batch's keys first; if their files are partitioned by the first key column, Spark reads
    only the batch's partitions.
    """
    keys = list(keys)
    schema = T.StructType([records.schema[k] for k in keys]).add("bucket", T.IntegerType())
    handed = Store(records.sparkSession, f"{path}/_handed", schema, "bucket")
    out = Store(records.sparkSession, path, records.schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(keys).withColumn("bucket", _bucket(keys[0])).persist()
        own = once.select(*keys)
        new = unannotated(once, annotations.join(own, keys, "left_semi"), keys)
        before = handed.read(before=batch_id).where(F.col("bucket").isin(_touched(once))).select(*keys)
        new = new.join(before, keys, "left_anti").persist()
        out.write_batch(new, batch_id)
        handed.write_batch(new.select(*keys, "bucket"), batch_id)
        if (batch_id + 1) % compact_every == 0:
            handed.compact(lambda rows: rows.select(*keys, "bucket").distinct(), least=compact_every - 1)
        new.unpersist()
        once.unpersist()

    return start(records.writeStream.foreachBatch(sink), checkpoint, **trigger)


# --- R6 -------------------------------------------------------------------------------
def stage_fold(log: DataFrame) -> DataFrame:
    """Mergeable start and end of each (experiment, stage)."""
    ended = F.col("status").isin("completed", "failed")
    return log.groupBy("experiment_id", "stage").agg(
        F.min(F.when(F.col("status") == "started", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.struct("ts", "status"))).alias("ended"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def merge_stages(folds: DataFrame) -> DataFrame:
    """Status and duration per stage; a stage without an end is ``open``."""
    merged = folds.groupBy("experiment_id", "stage").agg(
        F.min("started_at").alias("started_at"), F.max("ended").alias("ended"), F.sum("n_failed").alias("n_failed")
    )
    seconds = (F.unix_micros(F.col("ended.ts").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1_000_000)
    return merged.select(
        "experiment_id", "stage", "started_at", F.col("ended.ts").alias("ended_at"), F.coalesce("ended.status", F.lit("open")).alias("status"), seconds.alias("duration_sec"), "n_failed"
    )


def stage_durations(log: DataFrame) -> DataFrame:
    """Batch form of the same measure."""
    return merge_stages(stage_fold(log))


def stage_events(log: DataFrame) -> DataFrame:
    """The events that open or close a stage: experiment_id, stage, ts, event_id, status, payload (JSON text, null if the log has none)."""
    payload = F.col("payload").cast("string") if "payload" in log.columns else F.lit(None).cast("string")
    kept = log.where(F.col("status").isin("started", "completed", "failed"))
    return kept.select("experiment_id", "stage", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status", payload.alias("payload"))


STAGE_EVENTS = "experiment_id string, stage string, ts timestamp, event_id bigint, status string, payload string"


def stage_runs(events: DataFrame) -> DataFrame:
    """One row for every time a stage ran, from ``stage_events`` in any order.

    A start opens a run of its stage and the ends up to the next start belong to it; the last
    of them closes it.  A run without an end is ``open``; ends before any start form a run
    without a start, number 0.  ``counts`` holds the whole numbers of the payloads of its start
    and its last end, the end's over the start's.  Runs are counted in blocks of an hour, of
    which one row each meets the others, so a stage with very many events is many tasks' work.
    """
    key = ["experiment_id", "stage"]
    rows = events.withColumns({"__k": F.struct(*key), "__block": F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)).cast("bigint")})
    begins = F.col("status") == "started"
    sizes = rows.groupBy("__k", "__block").agg(F.count_if(begins).alias("__n"))
    before = W.partitionBy("__k").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = W.partitionBy("__k", "__block").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("__in", F.sum(F.when(begins, 1).otherwise(0)).over(inside)).join(sizes, ["__k", "__block"])
    numbered = numbered.withColumn("run_no", (F.col("__in") + F.col("__before")).cast("bigint"))
    event = F.struct("ts", "event_id", "status", "payload")
    merged = numbered.groupBy("__k", "run_no").agg(
        F.min(F.when(begins, event)).alias("s"), F.max(F.when(~begins, event)).alias("e"), F.count_if(F.col("status") == "failed").alias("n_failed")
    )
    whole = lambda p: F.coalesce(F.transform_values(numeric_map(parse_object(p)), lambda _, v: v.cast("bigint")), _no_counts())
    merged = merged.withColumns({"__s": whole(F.col("s.payload")), "__e": whole(F.col("e.payload"))})
    counts = F.map_concat(F.map_filter("__s", lambda k, _: ~F.map_contains_key("__e", k)), F.col("__e"))
    seconds = (F.unix_micros("e.ts") - F.unix_micros("s.ts")) / F.lit(1_000_000)
    return merged.select(
        "__k.experiment_id", "__k.stage", "run_no", F.col("s.ts").alias("started_at"), F.col("e.ts").alias("ended_at"),
        F.coalesce("e.status", F.lit("open")).alias("status"), seconds.alias("duration_sec"), "n_failed", counts.alias("counts"),
    )


def _no_counts() -> Column:
    return F.map_from_entries(F.array().cast("array<struct<key:string,value:bigint>>"))


# --- R7 -------------------------------------------------------------------------------
def expected_units(requests: Column | int, normalizers: int, scorers: int, plugins: int) -> Column:
    """requests x (1 + normalizers + scorers) + plugins, at least one."""
    r = F.greatest(F.lit(requests) if isinstance(requests, int) else requests, F.lit(0))
    total = r * (1 + max(normalizers, 0) + max(scorers, 0)) + max(plugins, 0)
    return F.greatest(total, r, F.lit(1))


def stage_progress(progress: DataFrame, plan: DataFrame, normalizers: int, scorers: int, plugins: int) -> DataFrame:
    """Evaluation progress per experiment: units expected, processed and failed, rate (1 decimal), ETA.

    ``progress``: experiment_id and the counters of ``progress_fold``; ``plan``: experiment_id, n_requests.
    """
    joined = plan.select("experiment_id", expected_units(F.col("n_requests"), normalizers, scorers, plugins).alias("units")).join(progress, "experiment_id", "left")
    ok, bad = F.coalesce("succeeded", F.lit(0)), F.coalesce("failed", F.lit(0))
    elapsed = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / F.lit(1_000_000)
    rate, eta = rate_and_eta(ok + bad, F.col("units"), F.coalesce(elapsed, F.lit(0.0)), 1)
    return joined.select("experiment_id", "units", (ok + bad).alias("processed"), bad.alias("failed"), rate.alias("rate_per_min"), eta.alias("eta_sec"))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
