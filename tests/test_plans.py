"""Plans: what must not be in them."""

import re

import pytest

from benchloom.catalog import QUERIES

# One summary row per block, file split, region or allocation: bounded, never the data.
SUMMARY_WINDOWS = {
    "S1_read_prompts_text", "S2_read_prompts_csv", "S6_import_legacy_prompts", "W5_number_records", "U1_merge_runs", "W2_cap_cases",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] in "PJAWUT" and not n.startswith("J14")))
def test_no_cartesian_and_no_global_window(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    if name not in SUMMARY_WINDOWS and windows:
        assert not re.search(r"Exchange SinglePartition.*\n(.*Sort.*\n)?.*Window", plan)
        for line in windows:
            assert not re.search(r"windowspecdefinition\([^,]*(ASC|DESC)", line), line


def test_filters_and_columns_reach_the_scan(spark, small):
    from benchloom.operators import cases as C
    from benchloom.catalog.views import Tables

    t = Tables(spark, small)
    df = C.filter_cases(t("v_cases"), C.Selection(splits=("train",))).select("case_id")
    scans = [line for line in plan_of(df).splitlines() if "FileScan" in line]
    assert all("text" not in re.search(r"ReadSchema: (.*)", line).group(1) for line in scans)
    led = t("v_ledger").where("event_id > 5").select("event_id")
    assert "GreaterThan(event_id,5)" in plan_of(led)


def test_group_limit_runs_before_the_shuffle(spark, small):
    plan = plan_of(QUERIES["W1_sample_per_group"](spark, small))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_request_product_has_no_join(spark, small):
    plan = plan_of(QUERIES["J1_expand_requests"](spark, small))
    assert "Generate explode" in plan and "NestedLoopJoin" not in plan


def test_bounded_tables_of_a_view_meet_texts_without_a_shuffle(spark, small, monkeypatch):
    from benchloom.catalog import views

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = lambda: plan_of(views.Tables(spark, small)("v_cases", small=("labels",)))
        assert "BroadcastHashJoin" in cases()
        monkeypatch.setattr(views, "SMALL_ROWS", 1)
        assert "SortMergeJoin" in cases() and "Broadcast" not in cases()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
