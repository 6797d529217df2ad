"""Files as they come: byte-order marks, blank lines, broken rows, missing layers."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from benchloom.functions import variants as V
from benchloom.plans import evaluate as E
from benchloom.plans.hooks import Hooks, plugin_order
from benchloom.operators import results as RS
from benchloom.session import shared_dir
from benchloom.sources import cases as SC, layers as SL, prompts as SP


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_text_numbers_after_dropping_blanks(spark, tmp_path):
    put(tmp_path, "d/a.txt", "﻿ first  line \n\n \t\n雨 的\n")
    put(tmp_path, "d/b.txt", "third\n")
    got = SP.read_prompts_text(spark, str(tmp_path / "d")).orderBy("seq").collect()
    assert [(r.prompt_id, r.prompt, r.language) for r in got] == [
        ("prompt_000001", "first line", "en"), ("prompt_000002", "雨 的", "zh"), ("prompt_000003", "third", "en"),
    ]


def test_text_in_many_splits_keeps_line_order(spark, tmp_path):
    path = put(tmp_path, "big.txt", "".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.prompt: r.seq for r in SP.read_prompts_text(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"line {i}": i + 1 for i in range(5000)}


def test_csv(spark, tmp_path):
    path = put(tmp_path, "p.csv", '﻿prompt_id,prompt,parameters,version\n,"a ""q"",\nb","{""seed"": 1}",v\n x1 , ,,\n,c,[1],\n')
    ok, bad = SP.read_prompts_csv(spark, path)
    assert [(r.prompt_id, r.prompt, r.language, r.version) for r in ok.collect()] == [("prompt_000001", 'a "q", b', "en", "v")]
    assert [r.prompt_id for r in bad.collect()] == ["prompt_000002"]
    assert ok.select(V.get_number("parameters", "seed").alias("s")).first().s == 1
    with pytest.raises(ValueError):
        SP.read_prompts_csv(spark, put(tmp_path, "q.csv", "text\nx\n"))


def test_jsonl(spark, tmp_path):
    rows = ['{"prompt_id": 5, "prompt": " a  b ", "metadata": {"k": [1]}}', "{oops", '{"prompt": "x"}', ""]
    ok, bad = SP.read_prompts_jsonl(spark, put(tmp_path, "p.jsonl", "\n".join(rows)))
    assert [(r.prompt_id, r.prompt) for r in ok.collect()] == [("5", "a b")]
    assert sorted(r.error for r in bad.collect()) == ["bad json", "missing prompt_id"]


def test_cases_payload_and_contract(spark, tmp_path):
    rows = [
        {"case_id": "a", "input_payload": {"instruction": "do", "decision_options": [{"id": "A", "text": "t"}]}, "expected_structure": "s"},
        {"prompt_id": "b", "prompt": " p ", "input_type": "image", "version": 2},
        {"case_id": "c", "input_payload": {"text": "only text"}},
        {"case_id": "", "prompt": "x"},
        {"case_id": "e"},
    ]
    ok, bad = SC.read_cases(spark, put(tmp_path, "c.jsonl", "\n".join(map(json.dumps, rows))), "bench", "static")
    got = {r.case_id: r for r in ok.collect()}
    assert set(got) == {"a", "b", "c"} and bad.count() == 2
    assert (got["a"].instruction, got["a"].rendered_input, got["a"].expected_output_contract) == ("do", "do", "s")
    assert (got["b"].prompt, got["b"].input_modality, got["b"].case_version, got["b"].split, got["b"].language) == ("p", "image", "2", "default", "en")
    assert got["c"].rendered_input == "only text" and got["c"].source_builder == "static"


def test_missing_layer_is_empty(spark, tmp_path):
    assert SL.read_layer(spark, str(tmp_path), "ledger").count() == 0


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "split string, n int")
    SL.write_layers({"cases": df}, str(tmp_path), {"cases": ["split"]})
    SL.write_layers({"cases": df.where("split = 'a'").withColumn("n", F.lit(9))}, str(tmp_path), {"cases": ["split"]})
    assert sorted((r.split, r.n) for r in spark.read.parquet(str(tmp_path / "cases")).collect()) == [("a", 9), ("b", 2)]


def test_manifests_newest_first(spark, tmp_path):
    put(tmp_path, "r1/run_manifest.json", json.dumps({"run_id": "r1", "created_at": "2024-01-01"}, indent=1))
    put(tmp_path, "r2/run_manifest.json", json.dumps({"run_id": "r2", "created_at": "2024-02-01"}))
    put(tmp_path, "r3/run_manifest.json", "{broken")
    assert [r.run_id for r in SL.read_manifests(spark, str(tmp_path)).collect()] == ["r2", "r1"]


def test_listing(spark, tmp_path):
    put(tmp_path, "x/a.txt", "1")
    put(tmp_path, "x/y/b.bin", "2")
    got = sorted(os.path.basename(r.path) for r in SL.list_files(spark, str(tmp_path / "x")).collect())
    assert got == ["a.txt", "b.bin"]


def test_shared_folder_is_the_configured_one():
    def session(conf, master, current=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: current)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)), sparkContext=context)

    assert shared_dir(session({"spark.checkpoint.dir": "hdfs://x/y/"}, "yarn")) == "hdfs://x/y"
    assert shared_dir(session({}, "yarn", "hdfs://z")) == "hdfs://z"
    with pytest.raises(RuntimeError):
        shared_dir(session({}, "yarn"))


def test_plugin_order_and_isolation(spark):
    assert plugin_order({"b": ("a",), "a": ()}) == ["a", "b"]
    with pytest.raises(ValueError):
        plugin_order({"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError):
        plugin_order({"a": ("zzz",)})


def test_row_hook_errors_become_rows(spark):
    def fn(row):
        if row["n"] == 2:
            raise KeyError("two")
        return [{"m": row["n"]}, {"m": row["n"] * 10}] if row["n"] == 3 else None

    hooks = Hooks()
    hooks.register_scorer("h", fn, "m bigint")
    good, bad = hooks.score("h", spark.sql("select 'k' || id source_record_id, id n from range(4)"))
    assert sorted((r.m, r.scorer_id) for r in good.collect()) == [(3, "h"), (30, "h")]
    assert [(r.source_record_id, r.error) for r in bad.collect()] == [("k2", "'two'")]


def test_evaluate_end_to_end(spark):
    cases = spark.sql("select 'c1' case_id, 'b' benchmark_id, 's' split, 'g' group_key union all select 'c2', 'b', 's', 'g'")
    requests = E.plan_requests(cases, ["m1", "m2"], "t")
    responses = spark.sql("select 't:m1:c1' prompt_id, 'm1' target_model, 'ra' source_run_id, 'rec1' source_record_id, 'I refuse' response_text union all select 't:m1:c2', 'm1', 'ra', 'rec2', 'sure'")
    judge = spark.sql("""select 'ra' source_run_id, 'rec1' source_record_id, '{"score": 2}' raw_reply union all select 'ra', 'rec2', 'nope'""")
    out = E.evaluate(cases, requests, responses, [RS.Normalizer("n")], [RS.Rule("r", "contains_any", ("refuse",))], judge)
    summary = {(r.metric, r.key, r.subkey): r.value for r in out["summary"].collect()}
    assert summary[("target_result_count", None, None)] == 2 and summary[("failure_count", None, None)] == 2
    assert summary[("counts_by_scorer", "judge", None)] == 1 and summary[("average_numeric_score", "r", "matched")] == 0.5
    assert {r.stage for r in out["failures"].collect()} == {"target_execution", "parse"}


def test_evaluate_without_any_scorer(spark):
    cases = spark.sql("select 'c1' case_id, 'b' benchmark_id, 's' split, 'g' group_key")
    responses = spark.sql("select 't:m1:c1' prompt_id, 'm1' target_model, 'ra' source_run_id, 'rec1' source_record_id, 'sure' response_text")
    out = E.evaluate(cases, E.plan_requests(cases, ["m1"], "t"), responses, [RS.Normalizer("n")], [])
    assert [(r.scorer_id, r.score_record_count) for r in out["group_analysis"].collect()] == [(None, 0)]
    assert out["failures"].count() == 0 and out["summary"].where("metric = 'score_record_count' and value = 0").count() == 1
