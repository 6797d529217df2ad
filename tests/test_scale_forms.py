"""Operators whose plan must not grow with the data's shape: batches, caps, themes, stores."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from benchloom.operators import cases as C
from benchloom.operators import numbering as N
from benchloom.operators import themes as TH


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(plan, name):
    """How often a physical operator stands in a plan; reused exchanges do not count."""
    return len(re.findall(rf"^[\s:+-]*(?:\*\(\d+\) )?{name}\b", plan, re.MULTILINE))


# --- batches --------------------------------------------------------------------------
def sequential(rows, size):
    out, no = {}, Counter()
    state: dict = {}
    for seq, key, sign in sorted(rows):
        no[key] += 1
        start, last = state.get(key, (0, object()))
        if last != sign or no[key] - start >= size:
            start = no[key]
        state[key] = (start, sign)
        out[seq] = (start, no[key] - start)
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_batches_with_null_keys_and_long_runs(spark, block_rows):
    rnd = random.Random(block_rows)
    rows, sign = [], None
    for i in range(300):
        if rnd.random() < 0.05:
            sign = rnd.choice(["a", "b", None, ""])
        rows.append((i * 2 + 1, rnd.choice(["m", "m", "m", None, "n"]), sign))
    df = spark.createDataFrame([(*r, "payload") for r in rows], "seq bigint, model string, s string, `__rn` string").repartition(5)
    got = N.pack_batches(df.withColumnRenamed("__rn", "note"), "model", "seq", "s", 4, block_rows=block_rows)
    assert got.columns == ["seq", "model", "s", "note", "batch_index", "batch_first"]
    assert {r.seq: (r.batch_first, r.batch_index) for r in got.collect()} == sequential(rows, 4)


def test_batches_shuffle_rows_once(spark, small):
    from benchloom.catalog import QUERIES

    plan = executed(QUERIES["W6_pack_batches"](spark, small)).split("== Initial Plan ==")[0]
    assert operators(plan, "Exchange") <= 4 and "NestedLoop" not in plan


# --- caps -----------------------------------------------------------------------------
@pytest.mark.parametrize("cap", [1, 40, 199, 500, 900])
@pytest.mark.parametrize("digits", [1, 4])
def test_cap_is_the_first_in_hash_order(spark, monkeypatch, cap, digits):
    import hashlib

    monkeypatch.setattr(C, "CAP_DIGITS", digits)
    ids = [f"c{i}" for i in range(400)] + ["hot"] * 200  # a third of the rows are one case
    df = spark.createDataFrame([(i, "x") for i in ids], "case_id string, split string").repartition(7)
    got = C.cap_cases(df, cap, 3)
    want = sorted(ids, key=lambda i: (hashlib.md5(f"3:cap:{i}".encode()).hexdigest(), i))[:cap]
    assert got.columns == df.columns and sorted(r.case_id for r in got.collect()) == sorted(want)


def test_cap_odd_tables(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "case_id string")
    assert C.cap_cases(df, 2).count() == 2 and C.cap_cases(df, 9).count() == 3 and C.cap_cases(df.limit(0), 2).count() == 0


def test_bundle_computes_the_selection_once(spark):
    df = spark.createDataFrame([(f"c{i}", "x", f"g{i % 9}") for i in range(300)], "case_id string, split string, fam string").withColumn(
        "metadata", F.parse_json(F.to_json(F.struct(F.col("fam").alias("family_id"))))
    )
    out = C.sample_bundle(df, C.Selection(group_selector="metadata.family_id", sample_size_per_group=10, max_cases=50))
    assert out.selected.count() == 50 and out.excluded.count() == 250
    assert "Window" not in executed(out.counts) and "Window" not in executed(out.excluded)
    assert sum(r.count_after for r in out.counts.collect()) == 50


def test_rank_in_order(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    got = N.rank_in_order(df, [F.desc("k"), F.asc("v")], "place").orderBy("place").collect()
    assert [(r.place, r.k, r.v) for r in got] == [(i, *kv) for i, kv in enumerate(sorted(((v % 7, v) for v in range(1000)), key=lambda x: (-x[0], x[1])), 1)]


# --- theme trees ----------------------------------------------------------------------
NODES = "path array<string>, ord array<int>, count bigint, tags array<string>, metadata map<string,string>, constraints map<string,string>"


def grown(seed, n):
    """A random tree: (path, ord, count, tags, metadata, constraints)."""
    rnd = random.Random(seed)
    nodes = [((), ())]
    rows = []
    for i in range(n):
        path, order = rnd.choice(nodes)
        k = sum(1 for p, _ in nodes if p[:-1] == path and p)
        path, order = (*path, rnd.choice([f"x{i}", f"a/b{i}"])), (*order, rnd.choice([k, k, 5]))  # sibling positions may tie
        nodes.append((path, order))
        rows.append((list(path), list(order), rnd.choice([None, None, rnd.randint(0, 9)]), [f"t{i % 3}"], {f"m{i % 4}": str(i)}, {f"c{i % 4}": str(i)}))
    return rows


def planned(rows):
    quota = {tuple(r[0]): r[2] for r in rows}
    total: dict[tuple, int] = {}
    out = {}
    for path in sorted(quota, key=len, reverse=True):
        taken = sum(v for p, v in total.items() if p[:-1] == path)
        own = max((quota[path] or 0) - taken, 0) if quota[path] is not None else 0
        total[path] = taken + own
        out[path] = (own, taken + own)
    return out


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 200), (3, 3)])
def test_quotas_of_any_tree(spark, seed, n):
    rows = grown(seed, n)
    got = TH.theme_quota_plan(spark.createDataFrame(rows, NODES).repartition(6))
    assert {tuple(r.path): (r.residual, r.total) for r in got.collect()} == planned(rows)


def test_quota_plan_does_not_grow_with_depth(spark):
    def exchanges(depth):
        rows = [([f"n{i}" for i in range(k)], [0] * k, 2 * depth - k, [], {}, {}) for k in range(1, depth + 1)]
        plan = TH.theme_quota_plan(spark.createDataFrame(rows, NODES))
        assert {r.depth: r.total for r in plan.collect()} == {k: 2 * depth - k for k in range(1, depth + 1)}
        return operators(executed(plan).split("== Initial Plan ==")[0], "Exchange")

    assert exchanges(3) == exchanges(14) <= 6


def test_constraints_and_level_spellings(spark):
    rows = [
        (["R"], [0], None, ["r"], {"a": "1"}, {"size": "big", "hue": "red"}), (["R", "S"], [0, 0], None, [], {}, {"size": "small"}),
        (["R", "S", "T"], [0, 0, 0], None, ["t"], {}, None), (["R", "S", "T", "U"], [0, 0, 0, 0], None, None, None, {"hue": "blue"}),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    for key in ("theme", "themes", "per_theme", " Per_Theme "):
        plan = TH.theme_quota_plan(nodes, None, {key: 2})
        assert {r.node: r.residual for r in plan.collect() if r.residual} == {"R/S/T/U": 2}
    plan = TH.theme_quota_plan(nodes, None, {"categories": 1})
    drawn = TH.draw_themes(nodes, plan).collect()
    assert [(r.constraints, list(r.tags), r.metadata) for r in drawn] == [({"size": "small", "hue": "blue"}, ["r", "t"], {"a": "1"})]
    without = TH.draw_themes(nodes.drop("constraints"), plan).collect()
    assert [r.constraints for r in without] == [{}]
    with pytest.raises(ValueError, match="galaxy"):
        TH.level_defaults({"galaxy": 1})
    assert TH.theme_quota_plan(nodes.limit(0)).collect() == []


# --- requests -------------------------------------------------------------------------
@pytest.mark.parametrize("block", [3, 1000])
def test_more_targets_than_a_row_unrolls(spark, monkeypatch, block):
    from benchloom.operators import requests as RQ

    monkeypatch.setattr(RQ, "BLOCK_TARGETS", block)
    cases = spark.createDataFrame([(f"c{i}", i) for i in range(7)] + [(None, 9)], "case_id string, n int").repartition(3)
    names = [f"m{i}" for i in range(1001 if block > 3 else 10)] + ["m0"]
    table = spark.createDataFrame([(m, 1) for m in names], "target_model string, __block int")
    for targets in (table, names):
        got = RQ.expand_requests(cases, targets, "t")
        assert "NestedLoop" not in executed(got) and "Cartesian" not in executed(got)
        assert got.columns == ["request_id", "task_id", "case_id", "n", "target_model"]
        assert Counter((r.target_model, r.case_id) for r in got.collect()) == Counter((m, f"c{i}" if i < 7 else None) for m in names for i in range(8))
    assert RQ.expand_requests(cases, table.limit(0), "t").count() == 0 and RQ.expand_requests(cases.limit(0), table, "t").count() == 0


def test_copied_targets_are_not_broadcast(spark, monkeypatch):
    from benchloom.operators import requests as RQ

    monkeypatch.setattr(RQ, "BLOCK_TARGETS", 10)
    cases = spark.range(50).select(F.concat(F.lit("c"), "id").alias("case_id"))
    targets = spark.range(200).select(F.concat(F.lit("m"), "id").alias("target_model"))
    got = RQ.expand_requests(cases, targets, "t")
    # Spark takes the blocks for small and would hold every copy of them in the driver
    assert "Broadcast" not in executed(got) and operators(executed(got), "ShuffledHashJoin") == 1
    assert got.select("request_id").distinct().count() == got.count() == 50 * 200


def test_copies_follow_the_root_of_the_product(spark, monkeypatch):
    from benchloom.operators import requests as RQ

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n_cases, n_targets in ((25_641, 900_000), (153_846, 5_400_000), (900_000, 2_000), (1, 5), (0, 1)):
        parts, slices = RQ._grid(n_cases, n_targets, tasks)
        assert parts * slices >= RQ.CELLS_PER_TASK * tasks and 1 <= parts <= n_targets
        cells = RQ.CELLS_PER_TASK * tasks
        fewest = min(p * n_cases - (-cells // p) * n_targets for p in range(1, min(cells, n_targets) + 1))
        assert parts * n_cases + slices * n_targets <= 1.5 * fewest
    # short runs of targets do not multiply the cases: 40 copies of each, were it one a run
    monkeypatch.setattr(RQ, "BLOCK_TARGETS", 10)
    cases = spark.range(60).select(F.concat(F.lit("c"), "id").alias("case_id"))
    targets = spark.range(400).select(F.concat(F.lit("m"), "id").alias("target_model"))
    dealt, grid = [], RQ._grid
    monkeypatch.setattr(RQ, "_grid", lambda *sizes: dealt.append((sizes, grid(*sizes))) or grid(*sizes))
    got = RQ.expand_requests(cases, targets, "t")
    assert got.select("request_id").distinct().count() == got.count() == 60 * 400
    assert len(dealt) == 1 and dealt[0][0] == (60, 400, tasks) and dealt[0][1][0] < 40


# --- judge replies --------------------------------------------------------------------
def test_pairs_of_one_record_id_are_made_in_several_tasks(spark, monkeypatch):
    from benchloom.operators import results as RS

    monkeypatch.setattr(RS, "CELL_ROWS", 20)
    ids = "select concat('r', id % 1) source_run_id, case when id < 300 then 'hot' when id < 310 then concat('k', id) end source_record_id"
    results = spark.sql(f"{ids}, concat('q', id) request_id, case when id % 2 = 0 then 's' end split from range(311)")
    replies = spark.sql(f"{ids}, parse_json('{{\"score\": 1}}') annotation from range(305)")
    got = RS.judge_to_scores(replies, results, "j").select("source_record_id", "request_id", F.spark_partition_id().alias("task"))
    rows = got.collect()
    want = {("hot", f"q{i}"): 300 for i in range(300)} | {(f"k{i}", f"q{i}"): 1 for i in range(300, 305)}
    assert Counter((r.source_record_id, r.request_id) for r in rows) == want
    assert len({r.task for r in rows if r.source_record_id == "hot"}) > 3


# --- label summaries ------------------------------------------------------------------
def test_rows_do_not_grow_with_labels(spark):
    from benchloom.operators import summaries as SM

    results = spark.createDataFrame([("m", "s", "g", f"c{i}") for i in range(30)] * 2, "target_model string, split string, group_key string, case_id string")
    scores = spark.createDataFrame([("m", f"c{i}", "sc", [f"l{i}", f"l{i % 3}"], {"v": float(i)}) for i in range(30)], "target_model string, case_id string, scorer_id string, labels array<string>, scores map<string,double>")
    want = Counter(x for i in range(30) for x in (f"l{i}", f"l{i % 3}"))
    (row,) = SM.group_summary(results, scores, most_names=4).collect()
    top = sorted(want, key=lambda x: (-want[x], x))[:4]
    assert (row.n_labels, row.score_record_count, row.label_counts) == (30, 60, {x: 2 * want[x] for x in top}) and row.scores == {"v": 14.5}
    assert {r.label: r.n for r in SM.group_labels(results, scores).collect()} == {x: 2 * n for x, n in want.items()}
