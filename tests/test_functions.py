"""Literal rows for the semantics that must not drift."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from benchloom.functions import guards, params, replies as R, signals as S, text as T, variants as V
from benchloom.functions.failures import categorize_failure
from benchloom.functions.groups import case_id_prefix, group_value, result_group_key, truthy_text
from benchloom.functions.template import append_choices, choices_block, compile_template


def col_of(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(3)
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


TEXTS = ["  a \t\n b　c ", "ﬁne ① ﾊﾝ", "", "\x1c\x1d x \x85 y ", None, "é", "Ａ　Ｂ"]


def test_normalize_text_is_nfkc_and_collapses_blanks(spark):
    want = [None if v is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v).strip()) for v in TEXTS]
    assert col_of(spark, TEXTS, T.normalize_text) == want


def test_strip_and_words_follow_unicode_blanks(spark):
    assert col_of(spark, TEXTS, T.strip_ws) == [None if v is None else v.strip() for v in TEXTS]
    texts = [v for v in TEXTS if v is not None]
    assert col_of(spark, texts, lambda c: F.size(T.words(c))) == [len(v.split()) for v in texts]


def test_language_and_aliases(spark):
    assert col_of(spark, ["雨", "ｱ", "豈", "abc"], T.infer_language) == ["zh", "en", "zh", "en"]
    assert col_of(spark, ["CN", "en_US", "", "FR ", None], T.language_alias) == ["zh", "en", "en", "fr", "en"]


def test_path_component_and_slug(spark):
    assert col_of(spark, ["a/b\\c:d\ne", "  ", None, "ok"], T.path_component) == ["a_b_c_d_e", "unknown", "unknown", "ok"]
    assert col_of(spark, [" Größe-1.0 ", "--", "A b"], T.slug) == ["größe_1_0", "item", "a_b"]


def test_digits_never_cut(spark):
    assert col_of(spark, [7, 1234567], lambda c: T.digits(c, 6), "bigint") == ["000007", "1234567"]


JSON_CASES = [
    ('{"a": 1}', {"a": 1}),
    ('x {"a": 1} y', {"a": 1}),
    ('```json\n{"a": {"b": 2}}\n```', {"a": {"b": 2}}),
    ('{"a": 1} and {"b": 2}', None),
    ("{'a': 1}", None),
    ("[1]", None),
    ('{"a": 1', None),
    ("", None),
    ('```\n{"a": 1}\n``` and a } brace', {"a": 1}),
    ('{"a": 1} trailing {', {"a": 1}),
    ('{"a": 1},{"b": 2}', None),
]


def test_json_payload_candidates(spark):
    got = col_of(spark, [t for t, _ in JSON_CASES], lambda c: F.to_json(R.json_payload(c)))
    assert [None if g is None else json.loads(g) for g in got] == [w for _, w in JSON_CASES]


def test_json_reply_aliases_and_missing(spark):
    spec = R.ReplySpec(required=("label", "tags"), aliases={"label": ["lbl", "l2"]})
    texts = ['{"label": "", "lbl": null, "l2": "x", "tags": ["t"]}', '{"label": "y", "tags": []}', "none", '{"label": 0, "tags": true}']
    got = col_of(spark, texts, lambda c: R.json_reply(c, spec))
    assert [(g.status, g.fields.get("label"), list(g.missing)) for g in got] == [
        ("parsed", "x", []), ("partial", "y", ["tags"]), ("invalid", None, ["label", "tags"]), ("parsed", "0", []),
    ]
    assert got[3].fields["tags"] == "True"


def test_json_text_value_falls_back_to_raw(spark):
    texts = ['{"prompt": " p "}', '{"other": 1}', " plain ", '{"prompt": "", "content": "c"}']
    assert col_of(spark, texts, lambda c: R.json_text_value(c, ["prompt", "content"])) == ["p", '{"other": 1}', "plain", "c"]


def test_tag_reply(spark):
    spec = R.ReplySpec(
        fields=("final_choice", "reason", "final_answer"), aliases={"final_choice": ["choice", "pick"]}, required=("final_choice",),
        required_in={"reason": ["full"]}, preferred_in={"final_answer": ["full"]}, fallbacks={"reason": [r"because\s+(.*)$"]},
        choices={"A": ["Option A"]},
    )
    texts = ["<Choice>  option a </CHOICE> because it\nfits", "<choice> </choice><pick>b</pick>", "nothing", "<thinking>t</thinking><choice>keep me</choice>"]
    got = col_of(spark, texts, lambda c: R.tag_reply(c, spec, "full"))
    assert [g.fields.get("final_choice") for g in got] == ["A", "B", None, "keep me"]
    assert got[0].fields["reason"] == "it\nfits" and got[0].fallback_source == {"reason": "pattern"}
    assert [list(g.missing) for g in got] == [[], ["reason"], ["final_choice", "reason", "final_answer"], ["reason"]]
    assert (got[3].trace_text, got[3].trace_source, got[0].trace_source) == ("t", "tag", "none")


def test_fallback_is_cut_at_4000(spark):
    spec = R.ReplySpec(fields=("f",), fallbacks={"f": ["x(.*)"]})
    got = col_of(spark, ["x" + "y" * 5000], lambda c: R.tag_reply(c, spec))
    assert len(got[0].fields["f"]) == 4000


def test_spec_rejects_pattern_without_group():
    with pytest.raises(ValueError):
        R.ReplySpec(fallbacks={"f": ["abc"]})


def test_section_reply(spark):
    spec = R.ReplySpec(fields=("answer", "why"), aliases={"answer": ["Final Answer", "Answer"], "why": ["Why"]})
    texts = ["# Answer\nyes\nsir\n\n## Why\nb", "Answer: no\nWhy: x\nmore\nNote Bene: z", "answer: lower\n", "# Why\n\n# Answer\nlast"]
    got = col_of(spark, texts, lambda c: R.section_reply(c, spec))
    assert [(g.fields.get("answer"), g.fields.get("why")) for g in got] == [("yes\nsir", "b"), ("no", "x\nmore"), ("lower", None), ("last", "# Answer\nlast")]


def test_trace_priority(spark):
    meta = lambda c: F.when(c == "m", F.parse_json(F.lit('{"thinking_content": " deep "}')))
    spec = R.ReplySpec(trace_patterns=("why: (.*)",))
    got = col_of(spark, ["m", "<thinking>a</thinking> why: b", "why: c", "none"], lambda c: R.reasoning_trace(c, spec, meta(c)))
    assert [(g.text, g.source) for g in got] == [("deep", "artifact_metadata"), ("a", "tag"), ("c", "text_pattern"), (None, "none")]


def test_refusal_blank_and_lists(spark):
    texts = ["", " \n", "I REFUSE", "Sorry!", "I'm sorry", "fine", None]
    assert col_of(spark, texts, S.refusal) == [True, True, True, True, True, False, True]
    assert col_of(spark, texts, S.structural_refusal) == [False, False, True, False, True, False, False]


def test_decision_lines(spark):
    long = "w" * 399 + " tail"
    texts = ["\n first \nsecond", "  ", long, "<Thinking>x\ny</thinking>\n\n  visible \nz"]
    assert col_of(spark, texts, S.first_line) == ["first", None, "w" * 399 + " ", "<Thinking>x"]
    assert col_of(spark, texts, S.first_visible_line) == ["first", None, "w" * 399 + " ", "visible"]


def test_confidence_priority_is_not_text_order(spark):
    texts = ["low then high", "Confidence: 0.75 high", "confidence 3", "uncertain, LOW", "lowest", "confidence: high", "éhigh"]
    got = col_of(spark, texts, S.confidence)
    assert [(g.value, g.label) for g in got] == [
        (None, "high"), (0.75, None), (3.0, None), (None, "low"), (None, None), (None, "high"), (None, None),
    ]


def test_failure_rule_order(spark):
    texts = [
        "conda env missing: artifact", "Environment for x not available", "did not become ready: from_pretrained", "did not become ready",
        "save image failed", "boom", "", None,
    ]
    assert col_of(spark, texts, categorize_failure) == [
        "env_error", "env_error", "model_load_error", "worker_startup_error", "artifact_collection_error", "task_execution_error", "unknown_error", "unknown_error",
    ]


def test_group_values(spark):
    assert col_of(spark, ["x_775", "x", "a_1_2", "_5", "x_"], case_id_prefix) == ["x", "x", "a_1", "_5", "x_"]
    meta = [{"k": True}, {"k": ""}, {"k": None}, {}, {"k": 3}, {"k": "v"}]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(meta)], "i int, j string").withColumn("metadata", F.parse_json("j"))
    got = [r.g for r in df.select("i", group_value("metadata.k").alias("g")).orderBy("i").collect()]
    assert got == ["True", "ungrouped", "ungrouped", "ungrouped", "3", "v"]
    with pytest.raises(ValueError):
        group_value("nope")


def test_truthiness(spark):
    meta = [{"k": 0}, {"k": False}, {"k": []}, {"k": {}}, {"k": "0"}, {"k": [1]}]
    got = col_of(spark, [json.dumps(m) for m in meta], lambda c: truthy_text(F.parse_json(c), "k"))
    assert got == [None, None, None, None, "0", "[1]"]
    key = col_of(spark, ['{"family_id": "f"}', "{}"], lambda c: result_group_key(F.parse_json(c), F.parse_json(F.lit('{"group_key": "g"}'))))
    assert key == ["f", "g"]


def test_numeric_map_leaves_booleans_out(spark):
    got = col_of(spark, ['{"a": 1, "b": true, "c": "2", "d": 0.5}'], lambda c: V.numeric_map(F.parse_json(c)))
    assert got == [{"a": 1.0, "d": 0.5}]


def test_param_coercion(spark):
    raw = [
        {"width": True}, {"width": "12"}, {"width": 12.9}, {"width": "12.5"}, {"temperature": "0.5"}, {"temperature": False}, {"stream": "YES"},
        {"stream": 1}, {"resolution": "64 X 32"}, {"resolution": 5}, {"what": [1]}, {"offload": None}, {"seed": None},
    ]
    got = col_of(spark, [json.dumps(r) for r in raw], lambda c: params.coerce(F.parse_json(c)))
    assert [g.width for g in got[:4]] == [None, 12, 12, None]
    assert [bool(g.errors) for g in got] == [True, False, False, True, False, True, False, True, False, True, False, True, True]
    assert got[4].temperature == 0.5 and got[6].stream is True and got[8].resolution == "64 X 32"
    assert got[10].extra == {"what": "[1]"} and got[10].warnings == ["unknown parameter: what"]


def test_merge_layers(spark):
    df = spark.sql(
        "select map('width','1','height','1','seed','0') a, map('resolution','64*32') b, map('resolution','9x9','width','7') c, cast(null as map<string,string>) d"
    )
    m = df.select(params.merge_layers(*[F.col(c) for c in "abcd"]).alias("m")).first().m
    assert m == {"width": "7", "height": "9", "seed": "0"}
    assert df.select((params.signature(F.col("a")) == params.signature(F.expr("map('seed','0','height','1','width','1')"))).alias("s")).first().s


def test_template(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    text, warn = compile_template("  {{ a }}-{{b}}-{{c}}{{ c }} {{d}}", {"a": F.col("a"), "b": F.col("b"), "d": F.lit("secret")}, ["a", "b", "gone"])
    row = df.select(text.alias("t"), warn.alias("w")).first()
    assert row.t == "x--"
    assert row.w == [
        "allowlisted template variable is unavailable: gone", "template variable is unavailable: c", "template variable is unavailable: d",
    ]


def test_choices(spark):
    df = spark.sql("select array(named_struct('id',' b','text','x '), named_struct('id','A','text','y')) o, array(named_struct('id','C','text','x')) bad")
    r = df.select(choices_block(F.col("o")).alias("o"), choices_block(F.col("bad")).alias("bad"), append_choices(F.lit("p"), F.col("bad"), F.col("o")).alias("p"),
                  append_choices(F.lit("p"), F.col("o"), header="", separator="\\n").alias("q"), append_choices(F.lit("p"), F.col("o"), enabled=False).alias("off")).first()
    assert (r.o, r.bad, r.p, r.q, r.off) == ("B. x\nA. y", None, "p", "p\nB. x\nA. y", "p")


def test_forbidden_terms_bounds(spark):
    texts = ["a test here", "contest", "Option  B now", "dogma", "latest"]
    got = col_of(spark, texts, lambda c: F.size(F.filter(F.array(*guards.forbidden_terms(c, ["test", "option b", "dog"])), lambda m: m.isNotNull())))
    assert got == [1, 0, 1, 1, 0]


def test_second_person(spark):
    assert col_of(spark, ["you", "Your\nx", "for you\n", "bayou!", "they"], guards.second_person) == [True, True, True, False, False]


def test_normalized_options(spark):
    raw = ['["go", "stay"]', '[{"id": "b", "text": "x"}, {"id": "A", "text": "y"}, 3]', '[{"id": "A", "text": "x"}, {"id": "A", "text": "y"}]', '["only"]', '["", "x"]']
    got = col_of(spark, raw, lambda c: guards.normalized_options(F.try_variant_get(F.parse_json(c), "$", "array<variant>")))
    assert [[(o.id, o.text) for o in g] for g in got] == [[("A", "go"), ("B", "stay")], [("A", "y"), ("B", "x")], [], [], []]


def test_batches_become_objects_slice_by_slice(monkeypatch):
    import pyarrow as pa

    from benchloom.functions import text as TX

    monkeypatch.setattr(TX, "SLICE_BYTES", 8)
    seen = []

    def convert(texts):
        seen.append(texts)
        return pa.array([t and t.upper() for t in texts], pa.string())

    rows = ["abc", None, "", "d" * 40, "e", "f", None, "雨雨雨"]
    run = TX.by_slices(convert)
    assert run(pa.array(rows)).to_pylist() == [t and t.upper() for t in rows] and [x for part in seen for x in part] == rows
    assert len(seen) == 3 and all(sum(len((t or "").encode()) for t in part[1:]) <= 8 for part in seen)
    assert run(pa.array([], pa.string())).to_pylist() == [] and run(pa.array(rows).slice(3, 2)).to_pylist() == ["D" * 40, "E"]


def test_a_filter_does_not_normalize_again(spark, small):
    from benchloom.catalog import QUERIES

    plan = QUERIES["S3_read_prompts_jsonl"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one for each branch
