"""Streams in several micro-batches against the batch form of the same measure."""

import pytest
from pyspark.sql import functions as F

from benchloom.operators import runs as RN
from benchloom.session import scratch_path
from benchloom.streaming import ledger as L
from benchloom.streaming.deltas import compact, read_deltas


@pytest.fixture(scope="module")
def ledger(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("run_"), F.col("user_id") % 2).alias("run_id"),
        F.concat(F.lit("model_"), F.col("user_id") % 3).alias("model_name"), F.concat(F.lit("p"), F.col("user_id")).alias("prompt_id"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("running").alias("status"),
    )


@pytest.fixture(scope="module")
def files(spark, ledger):
    """Five files in time order, one micro-batch each."""
    path = scratch_path(spark, "ledger-files")
    bounds = ledger.approxQuantile("event_id", [0.2, 0.4, 0.6, 0.8], 0.0)
    for low, high in zip([-1, *bounds], [*bounds, 1e12]):
        ledger.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, ledger, files):
    return L.read_stream(spark, files, ledger.schema, files_per_batch=1)


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


def test_state_over_batches_and_compaction(spark, ledger, files):
    base = scratch_path(spark, "state")
    L.stream_ledger_state(stream(spark, ledger, files), f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    deltas = read_deltas(spark, f"{base}/out")
    assert deltas.select("batch").distinct().count() == 5
    want = RN.key_outcomes(ledger).select("model_name", "prompt_id", F.when(F.col("rank") == 2, "success").otherwise("failed").alias("state"))
    same(L.ledger_state(deltas), want)
    compact(spark, f"{base}/out", f"{base}/one", lambda d: d.groupBy("model_name", "prompt_id").agg(F.max("rank").alias("rank")))
    same(L.ledger_state(spark.read.parquet(f"{base}/one")), want)
    # A second run over the same checkpoint has nothing to do.
    L.stream_ledger_state(stream(spark, ledger, files), f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    same(L.ledger_state(read_deltas(spark, f"{base}/out")), want)


def test_windows_over_batches(spark, ledger, files):
    base = scratch_path(spark, "windows")
    by = ["run_id", "model_name"]
    L.stream_throughput(stream(spark, ledger, files), f"{base}/out", f"{base}/cp", by, window="2 hours", available_now=True).awaitTermination()
    same(L.merge_throughput(read_deltas(spark, f"{base}/out"), by), L.throughput(ledger, by, "2 hours"))


def test_late_rows_count(spark, ledger):
    """Rows that come hours late, in a later batch and a second run, are written and counted."""
    path, base = scratch_path(spark, "late"), scratch_path(spark, "late-out")
    done = ledger.where("status <> 'running'")
    rates = lambda: L.stream_throughput(stream(spark, ledger, path), f"{base}/out", f"{base}/cp", ["run_id"], available_now=True)
    rows = lambda: L.ledger_sink(stream(spark, ledger, path), f"{base}/rows", f"{base}/cp2", available_now=True)
    parts = ["ts > '2024-01-01 12:00:00'", "ts < '2024-01-01 06:00:00'", "ts >= '2024-01-01 06:00:00' and ts <= '2024-01-01 12:00:00'"]
    for part in parts:
        done.where(part).coalesce(1).write.mode("append").parquet(path)
        rates().awaitTermination()
        rows().awaitTermination()
    same(L.merge_throughput(read_deltas(spark, f"{base}/out"), ["run_id"]), L.throughput(done, ["run_id"]))
    same(L.ledger_rows(read_deltas(spark, f"{base}/rows"), ["run_id", "event_id"]), done)


def test_snapshot(spark, ledger, files):
    base = scratch_path(spark, "snap")
    fold = lambda b: L.progress_fold(b, ["run_id"])
    from benchloom.streaming.deltas import stream_deltas

    stream_deltas(stream(spark, ledger, files), fold, f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    totals = ledger.groupBy("run_id").agg(F.count("*").alias("total"))
    streamed = L.throughput_snapshot(L.merge_progress(read_deltas(spark, f"{base}/out"), ["run_id"]), totals, ["run_id"])
    same(streamed, L.throughput_snapshot(L.merge_progress(fold(ledger), ["run_id"]), totals, ["run_id"]))


def test_rate_and_eta_arithmetic(spark):
    rows = [(2, 4, 30.0, 4.0, 30), (0, 4, 30.0, 0.0, None), (4, 4, 30.0, 8.0, None), (1, 3, 0.0, 0.0, None), (1, 2, 480.0, 0.125, 480)]
    df = spark.createDataFrame(rows, "p bigint, t bigint, s double, rate double, eta bigint")
    rate, eta = L.rate_and_eta(F.col("p"), F.col("t"), F.col("s"))
    for r in df.select("rate", "eta", rate.alias("r"), eta.alias("e")).collect():
        assert (r.r, r.e) == (r.rate, r.eta)
    units = spark.range(1).select(L.expected_units(10, 2, 1, 3).alias("a"), L.expected_units(0, 0, 0, 0).alias("b")).first()
    assert (units.a, units.b) == (43, 1)


@pytest.mark.parametrize("limits", [{"max_failures": 20}, {"max_rate": 0.05}, {"max_failures": 10_000}])
def test_budget_alerts_once_per_run(spark, ledger, files, limits):
    base = scratch_path(spark, "budget")
    plan = ledger.groupBy("run_id").agg(F.count("*").alias("planned_total"))
    L.budget_monitor(stream(spark, ledger, files), plan, f"{base}/out", f"{base}/cp", **limits, available_now=True).awaitTermination()
    alerts = read_deltas(spark, f"{base}/out/alerts").drop("batch")
    same(alerts, RN.failure_budget(ledger, plan, **limits))


def test_budget_without_a_plan(spark):
    """A run that no plan names is held to the count limit alone."""
    rows = [("r", f"2024-01-01 00:00:0{k}", k, "failed") for k in range(5)]
    ledger = spark.createDataFrame(rows, "run_id string, ts string, event_id bigint, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    plan = spark.createDataFrame([], "run_id string, planned_total bigint")
    got = RN.failure_budget(ledger, plan, max_failures=1).collect()
    assert [(r.event_id, r.failed_outputs, r.failure_rate) for r in got] == [(1, 2, 0.0)]
    assert RN.failure_budget(ledger, plan, max_rate=0.1).count() == 0
    path, base = scratch_path(spark, "noplan"), scratch_path(spark, "noplan-out")
    ledger.coalesce(1).write.parquet(path)
    L.budget_monitor(L.read_stream(spark, path, ledger.schema), plan, f"{base}/out", f"{base}/cp", 1, 0.1, available_now=True).awaitTermination()
    assert [(r.event_id, r.failed_outputs) for r in read_deltas(spark, f"{base}/out/alerts").collect()] == [(1, 2)]


def test_incremental_annotation_hands_out_once(spark, ledger, files):
    base = scratch_path(spark, "ann")
    rename = lambda df: df.select(F.col("run_id").alias("source_run_id"), F.col("prompt_id").alias("source_record_id"), "event_id")
    done = rename(ledger.where("status = 'success'"))
    L.incremental_annotation(rename(stream(spark, ledger, files)), done, f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    keys = ["source_run_id", "source_record_id"]
    got = read_deltas(spark, f"{base}/out").select(*keys)
    want = rename(ledger).select(*keys).distinct().join(done.select(*keys), keys, "left_anti")
    same(got, want)


def test_sink_drops_redelivered_rows(spark, ledger, files):
    base = scratch_path(spark, "sink")
    again = stream(spark, ledger, files)
    twice = again.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    L.ledger_sink(twice, f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    same(L.ledger_rows(read_deltas(spark, f"{base}/out"), ["run_id", "event_id"]), ledger)


def test_stage_pairs(spark, ledger, files):
    base = scratch_path(spark, "stages")
    log = lambda df: df.select(F.col("run_id").alias("experiment_id"), F.col("model_name").alias("stage"), "ts", F.when(F.col("status") == "running", "started").when(F.col("status") == "success", "completed").otherwise("failed").alias("status"))
    from benchloom.streaming.deltas import stream_deltas

    stream_deltas(log(stream(spark, ledger, files)), L.stage_fold, f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    same(L.merge_stages(read_deltas(spark, f"{base}/out")), L.stage_durations(log(ledger)))
    only = log(ledger).where("status = 'started'")
    assert {r.status for r in L.stage_durations(only).collect()} == {"open"}
