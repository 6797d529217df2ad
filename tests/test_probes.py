"""Rows that once gave wrong answers."""

from pyspark.sql import functions as F

from benchloom.functions import params as P
from benchloom.functions.replies import ReplySpec, pattern_value, structured_reply
from benchloom.operators import results as R
from benchloom.operators import runs as RN
from benchloom.operators import themes as TH
from benchloom.plans.hooks import Hooks

NODES = "path array<string>, ord array<int>, count bigint, tags array<string>, metadata map<string,string>"


def test_large_integers_stay_exact(spark):
    df = spark.sql("select parse_json('{\"seed\": 9007199254740993, \"num_inference_steps\": 3.0}') p")
    got = df.select(P.coerce(F.col("p")).alias("c")).select("c.*").first()
    assert got.seed == 9007199254740993


def test_deep_themes_and_slashes_in_names(spark):
    path = ["Media", "TV/Film", "c", "d", "e", "f"]
    rows = [(path[:k], list(range(1, k + 1)), 7 if k == 5 else 2 if k == 6 else None, [f"t{k}"], {"k": str(k)}) for k in range(1, 7)]
    rows += [(["Media", "TV"], [1, 3], None, [], {}), (["Media", "TV", "Film"], [1, 3, 1], 3, [], {})]
    nodes = spark.createDataFrame(rows, NODES)
    plan = TH.theme_quota_plan(nodes)
    kept = {tuple(r.path): (r.residual, r.total) for r in plan.collect()}
    assert kept[tuple(path)] == (2, 2) and kept[tuple(path[:5])] == (5, 7) and kept[("Media",)] == (0, 10)
    drawn = TH.draw_themes(nodes, plan).collect()
    assert len(drawn) == 10 and sorted({tuple(r.theme_path) for r in drawn}) == [("Media", "TV", "Film"), tuple(path)]
    assert {r.subcategory for r in drawn} == {"TV/Film", "TV"} and {r.theme for r in drawn} == {"f", "Film"}


def test_records_past_eight_digits_keep_their_order(spark):
    run = spark.createDataFrame([("r", f"rec_{n}") for n in (100000000, 99999999, 100000001)], "run_id string, record_id string")
    manifests = spark.createDataFrame([("r", None, None, None)], "run_id string, parent_run_id string, source_run_id string, recovery_mode string")
    got = RN.merge_runs([run], manifests).orderBy("record_id").collect()
    assert [r.source_record_id for r in got] == ["rec_99999999", "rec_100000000", "rec_100000001"]


def test_repeated_case_ids_give_one_row(spark):
    results = spark.createDataFrame([("q", "m", "c")], "request_id string, target_model string, case_id string")
    cases = spark.createDataFrame([("c", "old", 1), ("c", "new", 2)], "case_id string, prompt string, line int")
    requests = spark.createDataFrame([("q", "t1", 1), ("q", "t2", 2)], "request_id string, task_id string, line int")
    scores = spark.createDataFrame([("q", "m", s, "success", {s: 1.0}) for s in ("b", "a", "c")], "request_id string, target_model string, scorer_id string, status string, scores map<string,double>")
    normalized = spark.createDataFrame([("q", "m", "n", "success")], "request_id string, target_model string, normalizer_id string, status string")
    got = R.experiment_dataset(results, cases, requests, normalized, scores, order="line").collect()
    assert [(r.case_prompt, r.execution_request.task_id) for r in got] == [("new", "t2")]
    assert [s.scorer_id for s in got[0].score_records] == ["a", "b", "c"]
    assert R.experiment_dataset(results, cases, requests, normalized, scores).count() == 1


def test_textual_confidence_is_kept(spark):
    df = spark.sql("select parse_json('{\"confidence\": \"high\", \"score\": 0.5}') annotation")
    got = df.select(*[c.alias(k) for k, c in R.judgement().items()]).first()
    assert got.scores == {"score": 0.5} and got.score_texts == {"confidence": "high"}


def test_python_group_names_and_bad_patterns(spark):
    df = spark.createDataFrame([("ab ab", "r1", "k1", "m")], "response_text string, source_run_id string, source_record_id string, target_model string")
    rules = [R.Rule("named", "regex_any", (r"(?P<one_x>a)b (?P=one_x)b",)), R.Rule("bad", "regex_any", ("(",)), R.Rule("odd", "no_such_type", ("x",))]
    scores, failures = R.rule_scores(df, rules)
    assert [(r.scorer_id, r.scores) for r in scores.collect()] == [("named", {"matched": 1.0})]
    assert {r.scorer_id: r.error.split(":")[0] for r in failures.collect()} == {"bad": "bad pattern (", "odd": "unsupported rule type"}
    assert df.select(pattern_value("response_text", [r"(?P<n>a)b"]).alias("v")).first().v == "a"


def test_wrong_types_and_late_errors_stay_apart(spark):
    hooks = Hooks()
    hooks.register_scorer("typed", lambda r: {"m": "text" if r["n"] == 1 else r["n"]}, "m bigint")
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", None)], "source_record_id string, n bigint")
    good, bad = hooks.score("typed", rows)
    assert sorted((r.m is None, r.m) for r in good.collect()) == [(False, 0), (True, None)]
    assert [r.source_record_id for r in bad.collect()] == ["b"]
    hooks.register_plugin("fine", lambda layers, made: layers["rows"])
    hooks.register_plugin("late", lambda layers, made: layers["rows"].select(F.raise_error(F.lit("late fault")).alias("x")))
    hooks.register_plugin("after", lambda layers, made: made["late"], ("late",))
    outputs, errors = hooks.run_plugins({"rows": rows})
    assert outputs["fine"].count() == 3 and set(errors) == {"late", "after"} and "late fault" in errors["late"]


def test_json_reply_keeps_all_fields_and_the_trace(spark):
    texts = ['{"a":1,"b":"x"}', '<thinking>why</thinking> {"l": "", "l2": true, "n": null, "o": {"k": [1]}}', "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spec = ReplySpec(format="json_object", aliases={"l": ["l2"]}, required=("o",))
    one = df.select(structured_reply("t", ReplySpec(format="json_object")).alias("p")).collect()[0].p
    assert one.fields == {"a": "1", "b": "x"} and one.status == "parsed" and one.raw_hits == one.fields
    rows = [r.p for r in df.select(structured_reply("t", spec).alias("p")).collect()]
    assert rows[1].fields == {"l": "True", "l2": "True", "n": None, "o": '{"k":[1]}', "thinking": "why"} and rows[1].trace_source == "tag"
    assert [(r.status, list(r.missing)) for r in rows] == [("partial", ["o"]), ("parsed", []), ("invalid", ["o"])]


def test_every_format_through_normalizers_and_judges(spark):
    replies = {
        "json_object": 'so: {"label": "safe", "score": 0.75, "rationale": "r"}',
        "tag_blocks": "<label>safe</label><score>0.75</score><rationale>r</rationale>",
        "markdown_sections": "# label\nsafe\n# score\n0.75\n# rationale\nr",
        "plain_text": "safe",
    }
    for kind, text in replies.items():
        spec = ReplySpec(format=kind, fields=("label", "score", "rationale"), required=("text",) if kind == "plain_text" else ("label",))
        df = spark.createDataFrame([(text, "r1", "k1", "m"), ("", "r1", "k2", "m")], "response_text string, source_run_id string, source_record_id string, target_model string")
        rows = {r.source_record_id: r.extracted for r in R.normalize_results(df, [R.Normalizer("n", spec=spec)]).collect()}
        assert rows["k1"].parse_status == "parsed" and rows["k2"].parse_status in ("invalid", "partial")
        if kind != "plain_text":
            assert rows["k1"].raw_hits["label"] == "safe"
            scores, bad = R.judge_scores(df.withColumnRenamed("response_text", "raw_reply"), df, "j", ["label"], spec=spec)
            got = scores.collect()
            assert [(r.source_record_id, r.rationale) for r in got] == [("k1", "r")]
            assert got[0].scores | got[0].score_texts in ({"score": 0.75}, {"score": "0.75"})
            assert [r.source_record_id for r in bad.collect()] == ["k2"]
    odd = [R.Normalizer("n"), R.Normalizer("x", kind="unheard_of")]
    assert {r.normalizer_id for r in R.normalize_results(df, odd).collect()} == {"n"}
    assert {(r.normalizer_id, r.error) for r in R.normalizer_failures(df, odd).collect()} == {("x", "unsupported normalizer kind: unheard_of")}


def test_prompts_of_odd_cases_equal_their_sql(spark, tmp_path):
    """Repeated labels and ids, null languages, blank texts and texts with braces; the SQL gives one row a case."""
    import duckdb

    from benchloom.catalog import ORACLE, QUERIES

    name = "T21_prompts_from_replies"
    texts = [None, "", " \n", "a  b\n", '{"prompt": "other"}', 'a {"x": 1} b', "{}", "{ open"]
    given = [(None, None), (1, 0), (1, 1), (0, 0), (None, 1)]
    cases = [(t, g) for t in texts for g in given]
    docs = [(i, t, None if i % 2 else "en", f"src{i % 3}", 0) for i, (t, _) in enumerate(cases)] + [(15, "again", "de", "src0", 0)]
    labels = [(i, *g) for i, (_, g) in enumerate(cases) if g != (None, None)] + [(16, 1, 1), (16, 1, 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == len(cases) + 3


def test_prompts_with_a_sample_table_equal_those_that_carry_it(spark):
    from benchloom.operators import realizations as RZ

    schema = "sample_id string, raw_reply string, theme string, tags array<string>, metadata map<string,string>"
    rows = [("a", '{"prompt": " p  q ", "tags": ["x"]}', "t", ["s"], {}), ("b", "plain", "t", ["s"], {"theme": "other"}), ("c", " ", None, None, None)]
    replies = spark.createDataFrame(rows, schema)
    joined = RZ.prompts_from_replies(replies.select("sample_id", "raw_reply"), replies.drop("raw_reply"))
    carried = RZ.prompts_from_replies(replies).select(*joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, carried.collect()))
    assert {r.sample_id: (r.theme, r.tags) for r in carried.collect()} == {"a": ("t", ["x"]), "b": ("other", ["s"]), "c": (None, None)}
