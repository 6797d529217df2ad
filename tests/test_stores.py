"""Stores of merged batches, live state over restarts, and runs of stages."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from benchloom.session import scratch_path
from benchloom.streaming import ledger as L
from benchloom.streaming.store import CompactionConflict, Store

SUMS = lambda rows: rows.groupBy("k", "bucket").agg(F.sum("n").alias("n"))


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def folders(path):
    return sorted(n for n in os.listdir(local(path)) if n.startswith("batch=")), sorted(os.listdir(f"{local(path)}/_runs")) if os.path.isdir(f"{local(path)}/_runs") else []


def totals(store):
    return {r.k: r.n for r in SUMS(store.read()).collect()}


def batch(spark, k):
    return spark.createDataFrame([(f"k{k % 3}", k, k % 3), ("all", 1, 7)], "k string, n bigint, bucket int")


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "store"), "k string, n bigint, bucket int", "bucket")


def test_reads_are_the_same_before_and_after_merging(spark, store):
    assert store.read().count() == 0 and store.compact(SUMS).version == 0
    want: dict = {}
    for k in range(14):
        store.write_batch(batch(spark, k), k)
        want[f"k{k % 3}"] = want.get(f"k{k % 3}", 0) + k
        want["all"] = want.get("all", 0) + 1
        store.compact(SUMS, least=2, fan=2)
        assert totals(store) == want
        ids, runs = folders(store.path)
        assert len(ids) <= 5 and len(runs) <= 8  # bounded, whatever the number of batches
    assert max(level for _, level in store.manifest().runs) >= 2
    assert len(os.listdir(local(f"{store.path}/_manifest"))) <= 6  # two versions and their checksums


def test_a_replayed_batch_counts_once(spark, store):
    for k in range(5):
        store.write_batch(batch(spark, k), k)
    store.compact(SUMS, least=2, fan=2)
    before = totals(store)
    store.write_batch(batch(spark, 1), 1)  # merged already
    store.write_batch(batch(spark, 4), 4)  # the newest, which is never merged
    assert totals(store) == before
    with pytest.raises(ValueError):
        store.read(before=2)
    assert store.read(before=4).where("k = 'all'").agg(F.sum("n")).first()[0] == 4


def test_a_reader_under_way_ends_on_its_files(spark, store):
    for k in range(4):
        store.write_batch(batch(spark, k), k)
    under_way = store.read()
    store.compact(SUMS, least=2, fan=2)
    assert sum(r.n for r in under_way.collect()) == sum(totals(store).values())


def test_two_compactions_at_once(spark, store, monkeypatch):
    for k in range(4):
        store.write_batch(batch(spark, k), k)
    other = Store(spark, store.path, "k string, n bigint, bucket int", "bucket")
    stale = other.manifest()
    store.compact(SUMS, least=2, fan=2)
    monkeypatch.setattr(other, "manifest", lambda: stale)
    with pytest.raises(CompactionConflict):
        other.compact(SUMS, least=2, fan=2)
    with pytest.raises(ValueError):
        store.compact(SUMS, fan=1)
    assert totals(store)["all"] == 4


def test_a_reader_of_some_buckets_touches_their_files(spark, store):
    for k in range(6):
        store.write_batch(batch(spark, k), k)
    store.compact(SUMS, least=2, fan=2)
    files = store.read().where("bucket = 7").select("*", F.input_file_name().alias("file")).collect()
    assert files and all("bucket=7" in r.file for r in files)
    assert "PartitionFilters: [isnotnull(bucket" in store.read().where("bucket = 7")._jdf.queryExecution().executedPlan().toString()


LEDGER = "run_id string, ts timestamp, event_id bigint, status string"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, "run_id string, ts string, event_id bigint, status string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_budget_over_restarts_and_merging(spark):
    path, base = scratch_path(spark, "budget-files"), scratch_path(spark, "budget")
    plan = spark.createDataFrame([("r", 100), ("q", 100), ("old", 100)], "run_id string, planned_total bigint")
    run = lambda: L.budget_monitor(L.read_stream(spark, path, spark.createDataFrame([], LEDGER).schema), plan, f"{base}/out", f"{base}/cp", 5, compact_every=2, available_now=True).awaitTermination()
    for k in range(8):  # every file in a new run of the query
        arrive(spark, path, [("r", f"2024-01-0{k + 1} 00:00:00", k, "failed"), ("q", f"2024-01-0{k + 1} 00:00:01", 100 + k, "failed" if k < 3 else "success")])
        run()
    alerts = Store(spark, f"{base}/out/alerts", "run_id string, ts timestamp, event_id bigint, failed_outputs bigint, failure_rate double").read().collect()
    assert [(r.run_id, r.event_id, r.failed_outputs) for r in alerts] == [("r", 5, 6)]
    counts = Store(spark, f"{base}/out/counts", L._BUDGET, "bucket")
    assert counts.manifest().version > 0 and {r.run_id: r.failed for r in L.budget_merge()(counts.read()).collect()} == {"r": 8, "q": 3}
    kept = L.budget_merge("2 days")(counts.read()).collect()
    assert [r.run_id for r in kept] == ["r"]


def test_keys_are_handed_out_once_over_restarts(spark):
    path, base = scratch_path(spark, "ann-files"), scratch_path(spark, "ann")
    schema = spark.createDataFrame([], "source_run_id string, source_record_id string, x int").schema
    done = spark.createDataFrame([("r1", "a1")], "source_run_id string, source_record_id string")
    given = set()
    for k in range(7):
        rows = [(f"r{k // 3}", f"a{j}", k) for j in range(k + 1)] + [("r0", "a0", k), (None, "a9", k)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        given |= {(a, b) for a, b, _ in rows}
        L.incremental_annotation(L.read_stream(spark, path, schema), done, f"{base}/out", f"{base}/cp", compact_every=2, available_now=True).awaitTermination()
    got = [(r.source_run_id, r.source_record_id) for r in Store(spark, f"{base}/out", schema).read().collect() if r.source_run_id]
    assert len(got) == len(set(got)) and set(got) == {g for g in given if g[0]} - {("r1", "a1")}


def test_a_stage_that_runs_twice(spark):
    rows = [
        ("x", "s", "2024-01-01 10:00:00", 1, "started", '{"model_count": 2, "names": ["a"]}'), ("x", "s", "2024-01-01 10:00:10", 2, "failed", '{"error": "boom"}'),
        ("x", "s", "2024-01-01 12:00:00", 3, "started", '{"model_count": 2}'), ("x", "s", "2024-01-01 12:00:05", 4, "failed", None),
        ("x", "s", "2024-01-01 12:00:20", 5, "completed", '{"result_count": 7, "failure_count": 1, "model_count": 3}'), ("x", "s", "2024-01-03 00:00:00", 6, "started", "no json"),
        ("x", "t", "2024-01-01 10:00:00", 7, "completed", None), ("y", "s", "2024-01-01 10:00:00", 8, "note", None), (None, "s", "2024-01-01 10:00:00", 9, "started", None),
    ]
    log = spark.createDataFrame(rows, "experiment_id string, stage string, ts string, event_id bigint, status string, payload string").repartition(4)
    got = {(r.experiment_id, r.stage, r.run_no): (r.status, r.duration_sec, r.n_failed, r.counts) for r in L.stage_runs(L.stage_events(log)).collect()}
    assert got == {
        ("x", "s", 1): ("failed", 10.0, 1, {"model_count": 2}), ("x", "s", 2): ("completed", 20.0, 1, {"result_count": 7, "failure_count": 1, "model_count": 3}),
        ("x", "s", 3): ("open", None, 0, {}), ("x", "t", 0): ("completed", None, 0, {}), (None, "s", 1): ("open", None, 0, {}),
    }
    assert {r.counts == {} for r in L.stage_runs(L.stage_events(log.drop("payload"))).collect()} == {True}
