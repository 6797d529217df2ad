"""The end-to-end flows on small literal input."""

from pyspark.sql import functions as F

from benchloom.operators import results as RS
from benchloom.plans import evaluate as E


def test_theme_prompts(spark):
    path = ["a", "b/c", "d", "e", "f"]
    rows = [(path[:k], list(range(1, k + 1)), 6 if k == 5 else None, [], {}) for k in range(1, 6)]
    nodes = spark.createDataFrame(rows, "path array<string>, ord array<int>, count bigint, tags array<string>, metadata map<string,string>")
    pools = {"scene": ["s1", "s2"], "lighting": ["l1", "l2"], "weather": ["w1"], "subject_state": ["u1", "u2", "u3"], "camera": ["c1"], "realism_anchor": ["r1"]}
    drafts, log = E.build_theme_prompts(nodes, pools)
    got = drafts.collect()
    assert len(got) == 6 and {tuple(r.theme_path) for r in got} == {tuple(path)} and all(r.prompt.startswith("f. ") for r in got)
    assert log is not None and E.build_theme_prompts(nodes, pools, dedupe=False)[1] is None


def test_plan_tasks_packs_runs_of_one_signature(spark):
    rows = [(k, {"seed": "1"} if k < 5 else {"seed": "2"}) for k in range(8)]
    prompts = spark.createDataFrame(rows, "seq bigint, parameters map<string,string>")
    got = E.plan_tasks(prompts, {"steps": "30"}, "m", 3).orderBy("seq").collect()
    assert [r.batch_index for r in got] == [0, 1, 2, 0, 1, 0, 1, 2] and got[0].params["steps"] == "30"


def test_evaluate_reports_what_could_not_run(spark):
    cases = spark.createDataFrame([("c1", "p", "g", "train")], "case_id string, prompt string, group_key string, split string")
    requests = E.plan_requests(cases, ["m"], "t").withColumn("group_key", F.lit("g"))
    replies = requests.select("target_model", F.col("request_id").alias("prompt_id"), F.lit("yes").alias("response_text")).withColumns({"source_run_id": F.lit("r"), "source_record_id": F.lit("k")})
    layers = E.evaluate(cases, requests, replies, [RS.Normalizer("ok"), RS.Normalizer("odd", kind="none_such")], [RS.Rule("says", "contains_any", ("yes",)), RS.Rule("bad", "regex_any", ("[",))])
    assert layers["normalized_results"].count() == 1 and layers["score_records"].count() == 1
    assert sorted(r.error.split(":")[0] for r in layers["failures"].collect()) == ["bad pattern [", "unsupported normalizer kind"]
