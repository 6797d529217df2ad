"""Operators against plain Python on small, awkward rows."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from benchloom.operators import cases as C, duplicates as D, keyed as K, numbering as N, realizations as RZ, requests as RQ
from benchloom.operators import results as RS, runs as RN, summaries as SM, themes as TH

PARTITIONS = ["1", "7", "40"]


@pytest.fixture(params=PARTITIONS)
def shuffled(spark, request):
    """The session with a given number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


# --- duplicates -----------------------------------------------------------------------
def key_of(text):
    plain = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").strip())
    return re.sub(r"[^a-z0-9一-鿿 ]+", " ", plain.lower())


def brute_anchors(texts):
    keys = [key_of(t) for t in texts]
    sets = [set(k.split()) for k in keys]
    out = {}
    for j in range(len(texts)):
        exact = next((i for i in range(j) if keys[i] == keys[j]), None)
        if exact is not None:
            out[j] = (exact, "exact")
            continue
        for i in range(j):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and 10 * len(a & b) >= 9 * len(a | b)):
                out[j] = (i, "near")
                break
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rnd.sample(vocab, rnd.randint(1, 60)) for _ in range(25)]
    texts = ["", "  ", "!!!", "中文", "Ａ b", "a B!"]
    for words in base:
        for _ in range(rnd.randint(1, 4)):
            w = list(words)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rnd.shuffle(w) if rnd.random() < 0.3 else None
            texts.append((" " if rnd.random() < 0.5 else ", ").join(w))
    # A third of all rows is one family: exact copies, reorderings and copies with one odd word.
    family = rnd.sample(vocab, 30)
    for i in range(len(texts) // 2):
        w = list(family)
        if i % 3 == 1:
            rnd.shuffle(w)
        if i % 3 == 2:
            w.append(f"odd{i}")
        texts.append(" ".join(w))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(shuffled, seed):
    texts = corpus(seed)
    df = shuffled.createDataFrame(list(enumerate(texts)), "seq bigint, prompt string").repartition(5)
    got = {r.seq: (r.anchor_seq, r.kind) for r in D.near_duplicates(df).collect()}
    assert got == brute_anchors(texts)


def test_pairs_and_members_state_every_pair(spark):
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, prompt string")
    index = D.duplicate_index(df)
    set_of = {r.seq: r.set_first for r in index.members.collect()}
    pairs = {(r.left, r.right) for r in D.near_set_pairs(index).collect()}
    sets = [set(key_of(t).split()) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            a, b = sets[i], sets[j]
            near = (not a and not b) or (a and b and 10 * len(a & b) >= 9 * len(a | b))
            said = set_of[i] == set_of[j] or tuple(sorted((set_of[i], set_of[j]))) in pairs
            assert bool(near) == said, (i, j)


def test_hot_tokens_are_salted(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL_ROWS", 3)
    monkeypatch.setattr(D, "POPULAR", 4)
    texts = corpus(4)
    df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, prompt string")
    got = {r.seq: (r.anchor_seq, r.kind) for r in D.near_duplicates(df).collect()}
    assert got == brute_anchors(texts)


def test_pairs_at_the_threshold_of_every_size(spark):
    """Sets just at 9/10 are found, those just below are not, in and across size classes."""
    texts = []
    for n in (9, 10, 11, 12, 18, 19, 20, 21, 37, 38, 39, 99, 100, 190, 400, 2000):
        own = [f"s{n}t{k}" for k in range(n)]
        drop, swap = n // 10, n // 19
        other = [f"o{n}t{k}" for k in range(n)]
        texts += [own, own[drop:], own[: n - drop - 1], own[swap:] + other[:swap], own[swap + 1 :] + other[: swap + 1], own + other[: n // 9], own + other[: n // 9 + 1]]
    sets = [set(t) for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "seq bigint, prompt string")
    got = {(r.left, r.right) for r in D.near_set_pairs(D.duplicate_index(df)).collect()}
    first = [sets.index(s) for s in sets]
    every = sorted(set(first))
    assert got == {(i, j) for i in every for j in every if i < j and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])}


def test_strangers_over_few_words_are_no_candidates(spark, monkeypatch):
    """Texts that only share a small vocabulary hardly meet; the comparisons follow the rows."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.sample(vocab, 60)) for _ in range(600)]
    tried, verified = [], D._verified

    def counted(candidates, sets):
        tried.append(candidates.count())
        return verified(candidates, sets)

    monkeypatch.setattr(D, "_verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, prompt string")
    assert D.near_duplicates(df).count() == 0
    assert sum(tried) <= 60


def test_only_sets_that_candidates_name_are_moved(spark, monkeypatch):
    sets = spark.range(1000).select(F.col("id").alias("set_first"), F.array(F.col("id").cast("string")).alias("tokens"))
    named = spark.createDataFrame([(3,), (3,), (998,), (5000,)], "id bigint")
    near = D._marked(sets, "set_first", named).where("marked")
    assert near.columns == ["set_first", "tokens", "marked"] and {3, 998} <= {r.set_first for r in near.collect()} and near.count() < 10
    assert D._marked(sets, "set_first", named.limit(0)).where("marked").count() == 0
    # a map so small that most bits are set lets by more sets and changes nothing else
    monkeypatch.setattr(D, "MAP_BITS", 64)
    assert D._marked(sets, "set_first", named).where("marked").count() > 10
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, prompt string")
    assert {r.seq: (r.anchor_seq, r.kind) for r in D.near_duplicates(df).collect()} == brute_anchors(texts)


def test_keys_and_sketches_do_not_depend_on_slices(spark, monkeypatch):
    sets = spark.createDataFrame([(i, [f"t{k}" for k in range(i * 7 % 60)]) for i in range(50)], "set_first bigint, tokens array<string>").coalesce(1)
    whole = [sorted(map(str, df.collect())) for df in D._keyed(sets)]
    monkeypatch.setattr(D, "SLICE_TOKENS", 100)
    assert [sorted(map(str, df.collect())) for df in D._keyed(sets)] == whole and all(whole)


def test_a_round_writes_no_text_and_its_tokens_once(spark, monkeypatch):
    written, cut = [], D.cut
    for module in (D, TH):
        monkeypatch.setattr(module, "cut", lambda df, label="cut": written.append((label, df.columns)) or cut(df, label))
    samples = spark.createDataFrame([(f"s{i}", i, f"theme {i % 6} " + " ".join(f"w{i % 6}x{k}" for k in range(40))) for i in range(12)], "sample_id string, seq bigint, theme string")
    pools = {"scene": ["a", "b"]}
    final, _log = TH.dedupe_regenerate(TH.compose_drafts(samples, pools, "keyword_list"), pools, "keyword_list")
    assert final.count() == 12
    assert [label for label, columns in written if "tokens" in columns] == ["tokens"] * 2
    assert not [label for label, columns in written if {"prompt", "theme"} & set(columns)]


def test_dedupe_regenerate_follows_the_anchors(spark):
    pools = {"scene": ["one", "two", "three"], "lighting": ["dawn", "dusk"]}
    words = " ".join(f"t{i}" for i in range(40))
    rows = [(f"s{i}", i, words if i < 8 else words + f" x{i} y{i} z{i} q{i} r{i} u{i}") for i in range(12)]
    drafts = TH.compose_drafts(spark.createDataFrame(rows, "sample_id string, seq bigint, theme string"), pools, "keyword_list")
    first = {r.seq: r.prompt for r in drafts.collect()}
    final, log = TH.dedupe_regenerate(drafts, pools, "keyword_list")
    texts = dict(first)
    marked = defaultdict(set)
    for r in log.collect():
        marked[r.dedupe_pass].add(r.seq)
    assert marked[1] == set(brute_anchors([texts[i] for i in range(12)]))
    after = {r.seq: r.prompt for r in final.collect()}
    assert set(after) == set(range(12)) and after[0] == first[0]
    assert all(after[i] == first[i] for i in range(12) if i not in marked[1] | marked[2])


# --- numbering and batches ------------------------------------------------------------
def test_number_records_is_dense_and_ordered(shuffled):
    rows = [(f"r{i}", f"run_{i % 3}", i) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = shuffled.createDataFrame(rows, "record_id string, run_id string, seq int").repartition(9)
    got = N.number_records(df, ["run_id", "seq"]).collect()
    want = {r[0]: f"rec_{i:08d}" for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert {r.source_record_id: r.record_id for r in got} == want


def batches_of(rows, size):
    out, current, sign = {}, [], None
    for seq, s in rows:
        if current and (len(current) >= size or s != sign):
            current = []
        if not current:
            sign, start = s, seq
        current.append(seq)
        out[seq] = (start, len(current) - 1)
    return out


def test_pack_batches_equals_sequential_cut(shuffled):
    rnd = random.Random(5)
    rows, sign = [], "a"
    for i in range(400):
        if rnd.random() < 0.15:
            sign = rnd.choice(["a", "b", None])
        rows.append((i * 3, "hot" if rnd.random() < 0.9 else "cold", sign))
    df = shuffled.createDataFrame(rows, "seq bigint, model string, s string").repartition(6)
    got = N.pack_batches(df, "model", "seq", "s", 4, block_rows=50).collect()
    for model in ("hot", "cold"):
        mine = sorted((r.seq, r.batch_first, r.batch_index) for r in got if r.model == model)
        want = batches_of([(q, s) for q, m, s in rows if m == model], 4)
        number = {q: i for i, (q, _, _) in enumerate(mine, 1)}
        assert {q: (first, i) for q, first, i in mine} == {q: (number[start], i) for q, (start, i) in want.items()}


def test_batch_size_rule():
    assert N.batch_size(8, 4, 2) == 2 and N.batch_size(8, 4, 0) == 1 and N.batch_size(8, 4, 9, supported=False) == 1


def test_shards_cycle(shuffled):
    df = shuffled.createDataFrame([(i, "m") for i in range(0, 100, 2)], "seq bigint, model string")
    got = {r.seq: r.shard for r in N.assign_shards(df, "model", "seq", 3, block_rows=7).collect()}
    assert got == {s: i % 3 for i, s in enumerate(range(0, 100, 2))}


# --- selection ------------------------------------------------------------------------
def cases(spark, rows):
    return spark.createDataFrame(rows, "case_id string, split string, fam string, tags array<string>").withColumn(
        "metadata", F.parse_json(F.to_json(F.struct(F.col("fam").alias("family_id"))))
    )


def test_selection_policies(spark):
    df = cases(spark, [("a1", "x", "alpha", ["t"]), ("a2", "x", "alpha", []), ("b1", "x", "beta", ["u"])])
    spec = C.Selection(group_selector="metadata.family_id", sample_size_per_group=2)
    out = C.sample_bundle(df, spec)
    assert out.selected.count() == 3 and [r.asDict() for r in out.undersized.collect()] == [{"group_key": "beta", "requested_count": 2, "actual_count": 1}]
    dropped = C.sample_bundle(df, C.Selection(group_selector="metadata.family_id", sample_size_per_group=2, undersized="drop_group"))
    assert sorted(r.case_id for r in dropped.selected.collect()) == ["a1", "a2"] and [r.case_id for r in dropped.excluded.collect()] == ["b1"]
    with pytest.raises(C.SelectionError):
        C.sample_bundle(df, C.Selection(group_selector="metadata.family_id", sample_size_per_group=2, undersized="error"))
    with pytest.raises(C.SelectionError):
        C.Selection(max_cases=0)
    assert [r.case_id for r in C.filter_cases(df, C.Selection(tags=("u", "z"))).collect()] == ["b1"]
    many = C.Selection(include_ids=tuple(f"q{i}" for i in range(C.INLINE_IDS + 1)) + ("a2",))
    assert [r.case_id for r in C.filter_cases(df, many).collect()] == ["a2"]
    assert C.filter_cases(df, C.Selection(exclude_ids=("a1", "b1"))).count() == 1


def test_sample_does_not_depend_on_partitioning(shuffled):
    rows = [(f"c{i}", "x", "hot" if i % 10 else "cold", []) for i in range(3000)]
    df = cases(shuffled, rows).repartition(11)
    got = sorted(r.case_id for r in C.sample_per_group(df, F.col("fam"), 7, 42)[0].collect())
    want = []
    for fam in ("hot", "cold"):
        want += sorted((r[0] for r in rows if r[2] == fam), key=lambda c: (hashlib.md5(f"42:{c}".encode()).hexdigest(), c))[:7]
    assert got == sorted(want)


def test_validate_prompts_marks_the_later_row(spark):
    df = spark.createDataFrame([(3, "p", "x", "en"), (1, "p", "x", "en"), (2, "", "x", "en"), (5, "", "", "xx"), (4, "q", None, "zh")], "seq int, prompt_id string, prompt string, language string")
    ok, bad = C.validate_prompts(df)
    assert [r.seq for r in ok.collect()] == [1]
    assert {r.seq: list(r.errors) for r in bad.collect()} == {
        3: ["duplicate prompt_id"], 2: ["missing prompt_id"], 5: ["missing prompt_id", "empty prompt", "unsupported language"], 4: ["empty prompt"],
    }
    with pytest.raises(ValueError):
        C.validate_prompts(df, strict=True)


def test_exportable_order(spark):
    rows = [("m1", "success", "/a"), ("m2", "failed", ""), ("m1", "failed", "/a"), ("m1", "success", " "), ("m1", "success", "/gone"), ("", "success", "/a")]
    df = spark.createDataFrame(rows, "model_name string, status string, artifact_path string")
    listing = spark.createDataFrame([("/a",), ("/a",)], "path string")
    got = sorted(r.disposition for r in C.exportable(df, ["m1"], listing).collect())
    assert Counter(got) == {"exported": 1, "filtered": 2, "skipped": 3}
    assert {r.disposition for r in C.exportable(df, ["unknown-model"]).where("model_name = ''").collect()} == {"exported"}


# --- requests -------------------------------------------------------------------------
def test_requests_from_list_and_table(spark):
    df = spark.createDataFrame([("c1",), ("c2",)], "case_id string")
    a = RQ.expand_requests(df, ["m1", "m2"], "t").select("request_id").collect()
    b = RQ.expand_requests(df, spark.createDataFrame([("m1",), ("m2",)], "target_model string"), "t").select("request_id").collect()
    assert sorted(a) == sorted(b) and len(a) == 4 and ("t:m1:c1",) in a


def test_preview_stages():
    assert RQ.parse_stages("judge") == ["judge"] and RQ.parse_stages("x") == ["target", "judge"]
    assert RQ.parse_stages("judge,target") == RQ.parse_stages("TARGET+judge") == RQ.parse_stages(None) == ["target", "judge"]


def test_attach_overlays_metadata(spark):
    req = spark.sql("select 'r1' request_id, 'm' target_model, 'c' case_id, map('a','1','b','1') metadata union all select 'r2', 'n', 'c', map('a','1')")
    rep = spark.sql("select 'r1' prompt_id, 'm' target_model, map('b','2') prompt_metadata, 'x' response_text union all select 'zz', 'm', map(), 'y'")
    results, failures = RQ.attach_responses(req, rep)
    assert [r.metadata for r in results.collect()] == [{"a": "1", "b": "2"}]
    assert [r.target_model for r in failures.collect()] == ["n"]


# --- results --------------------------------------------------------------------------
def test_judge_join_keeps_runs_apart(spark):
    """Two targets share a record id; each reply stays with its own run."""
    results = spark.sql("select 'run_a' source_run_id, 'rec_1' source_record_id, 'm1' target_model, 'q1' request_id union all select 'run_b', 'rec_1', 'm2', 'q2'")
    replies = spark.sql("""select 'run_a' source_run_id, 'rec_1' source_record_id, '{"labels": ["a"], "score": true, "confidence": 0.5}' raw_reply union all select 'run_b', 'rec_1', 'x {"normative_labels": [1, true]} y'
        union all select 'run_c', 'rec_1', '{}'""")
    scores, bad = RS.judge_scores(replies, results, "j")
    got = {r.target_model: (list(r.labels), r.scores) for r in scores.collect()}
    assert got == {"m1": (["a"], {"confidence": 0.5}), "m2": (["1", "True"], {})}
    assert bad.count() == 0
    _ok, missing = RS.parse_annotations(replies, ["labels"])
    assert {r.error_message for r in missing.collect()} == {"missing required keys: labels"}


def test_group_summary_fan_out_and_empty_groups(spark):
    results = spark.sql("select 'm' target_model, 's' split, 'g' group_key, 'c1' case_id union all select 'm','s','g','c1' union all select 'm','s','h','c2'")
    scores = spark.sql("select 'm' target_model, 'c1' case_id, 'sc' scorer_id, array('x','y') labels, map('v', 1.0D) scores union all select 'm','c1','sc',array('x'),map('v', 0.0D, 'w', 4.0D)")
    rows = {r.group_key: r for r in SM.group_summary(results, scores).collect()}
    g, h = rows["g"], rows["h"]
    assert (g.case_count, g.score_record_count, g.label_counts, g.scores, list(g.labels)) == (2, 4, {"x": 4, "y": 2}, {"v": 0.5, "w": 4.0}, ["x", "y"])
    assert (h.scorer_id, h.case_count, h.score_record_count, list(h.labels)) == (None, 1, 0, [])


def test_preferred_normalized_when_all_failed(spark):
    df = spark.sql("select 'r' request_id, 'm' target_model, 'b' normalizer_id, 'failed' status union all select 'r','m','a','error' union all select 'q','m','z','SUCCESS' union all select 'q','m','a','failed'")
    assert {r.request_id: r.normalizer_id for r in K.preferred_normalized(df).collect()} == {"r": "a", "q": "z"}


def test_last_wins_keeps_nulls(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None)], "k string, n int, v string")
    assert K.last_wins(df, ["k"], ["n"]).first().v is None


def test_rules(spark):
    df = spark.createDataFrame([("A b",), (" x ",), ("",), (None,)], "response_text string").withColumn("source_record_id", F.monotonically_increasing_id())
    scores, failed = RS.rule_scores(df, [RS.Rule("e", "exact_match", ("x",)), RS.Rule("c", "contains_any", ("A B",), ("l",)), RS.Rule("z", "huh", ())])
    assert sorted((r.scorer_id, r.scores["matched"], tuple(r.labels)) for r in scores.collect()) == [
        ("c", 0.0, ()), ("c", 0.0, ()), ("c", 0.0, ()), ("c", 1.0, ("l",)), ("e", 0.0, ()), ("e", 0.0, ()), ("e", 0.0, ()), ("e", 1.0, ("e",)),
    ]
    assert failed.count() == 4


# --- recovery -------------------------------------------------------------------------
def test_recovery_any_order(shuffled):
    planned = shuffled.createDataFrame([("t1", "m", "p1"), ("t1", "m", "p2"), ("t2", "m", "p3"), ("t3", "m", "p4")], "task_id string, model_name string, prompt_id string")
    ledger = shuffled.createDataFrame([("m", "p1", "success"), ("m", "p1", "failed"), ("m", "p9", "failed"), ("", "p2", "failed"), ("m", "p4", "running")], "model_name string, prompt_id string, status string")
    failures = shuffled.createDataFrame([("t1",), ("t7",), ("",)], "task_id string")
    tasks = RN.failed_task_prompts(planned, failures)
    state = {(r.prompt_id, r.state, r.planned) for r in RN.recovery_state(planned, ledger, tasks).collect()}
    assert state == {("p1", "success", True), ("p2", "failed", True), ("p3", "missing", True), ("p4", "missing", True), ("p9", "failed", False)}
    assert [r.prompt_id for r in RN.failed_items(planned, ledger, tasks).collect()] == ["p2"]
    assert sorted(r.prompt_id for r in RN.missing_items(planned, ledger, tasks).collect()) == ["p3", "p4"]


def test_ledger_from_tasks(spark):
    planned = spark.createDataFrame([("t1", "p1"), ("t1", "p2"), ("t2", "p3"), ("t2", "p4"), ("t3", "p5")], "task_id string, prompt_id string")
    rows = [
        ("t1", "boom", [("p1", "success", None, None, [("image", "/a"), ("image", "/b")]), ("p2", None, 7, " why ", [])]),
        ("t2", "boom", []),
        ("t3", None, [("other", "success", None, None, [])]),
    ]
    results = spark.createDataFrame(rows, f"task_id string, error_message string, batch_items {RN.ITEM}")
    got = {r.prompt_id: (r.status, r.artifact_path, r.artifact_count, r.error_message, r.batch_index) for r in RN.ledger_from_tasks(results, planned).collect()}
    late = "Task failed before prompt-level outputs were available."
    assert got == {
        "p1": ("success", "/a", 2, None, 0), "p2": ("failed", None, 0, "boom", 7), "p3": ("failed", None, 0, "boom", None),
        "p4": ("failed", None, 0, "boom", None), "p5": ("failed", None, 0, late, None),
    }
    assert sorted(r.artifact_path for r in RN.flatten_batches(results, planned).collect()) == ["/a", "/b"]


def test_failure_budget_is_strict(shuffled):
    rows = [(i, f"2024-01-01 0{i // 60}:{i % 60:02d}:00", "r", "failed" if i % 2 else "success") for i in range(200)]
    ledger = shuffled.createDataFrame(rows, "event_id bigint, ts string, run_id string, status string").withColumn("ts", F.to_timestamp("ts"))
    plan = shuffled.createDataFrame([("r", 50)], "run_id string, planned_total bigint")
    hit = lambda **kw: [(r.event_id, r.failed_outputs) for r in RN.failure_budget(ledger, plan, **kw).collect()]
    assert hit(max_failures=1) == [(3, 2)]
    assert hit(max_rate=0.1) == [(11, 6)]
    assert hit(max_failures=3, max_rate=0.9) == [(7, 4)]
    assert hit(max_failures=500) == [] and hit(max_failures=0) == [(1, 1)]
    kept = RN.rows_within_budget(ledger, RN.failure_budget(ledger, plan, max_failures=1))
    assert kept.count() == 4
    assert RN.resolve_policy(None, 3, None) and not RN.resolve_policy(None, None, None)
    with pytest.raises(ValueError):
        RN.resolve_policy(None, None, 1.5)


@pytest.mark.parametrize("planned,rate", [(p, r) for p in (1, 3, 7, 10, 29, 100, 1000) for r in (0.0, 0.1, 0.29, 0.3, 0.7, 1.0)])
def test_breach_rank_is_exact(spark, planned, rate):
    want = next((n for n in range(1, planned + 2) if n / planned > rate), None)
    got = spark.range(1).select(RN.breach_rank(F.lit(planned), None, rate).alias("x")).first().x
    assert got == want


def test_merge_runs_needs_one():
    with pytest.raises(ValueError):
        RN.union_runs([])


# --- themes ---------------------------------------------------------------------------
def tree(spark, rows):
    """rows: (path, ord, count, tags)."""
    return spark.createDataFrame(rows, "path array<string>, ord array<int>, count bigint, tags array<string>").withColumn(
        "metadata", F.create_map(F.lit("at"), F.element_at("path", -1))
    )


ANIMALS = [
    (["Animals"], [1], 4, ["a", "x"]), (["Animals", "Marine"], [1, 1], 2, ["m", "x"]), (["Animals", "Marine", "Whale"], [1, 1, 1], None, []),
    (["Animals", "Land"], [1, 2], None, ["l"]), (["Animals", "Land", "Fox"], [1, 2, 1], None, ["f"]),
]


def test_quota_and_draws(spark):
    nodes = tree(spark, ANIMALS)
    plan = TH.theme_quota_plan(nodes)
    assert {r.node: r.residual for r in plan.collect() if r.residual} == {"Animals": 2, "Animals/Marine": 2}
    got = sorted((r.sample_id, "/".join(r.theme_path), r.resampled, list(r.tags), r.metadata["at"]) for r in TH.draw_themes(nodes, plan).collect())
    assert got == [
        ("sample_000001", "Animals/Marine/Whale", False, ["m", "x"], "Whale"), ("sample_000002", "Animals/Marine/Whale", True, ["m", "x"], "Whale"),
        ("sample_000003", "Animals/Land/Fox", False, ["a", "x", "l", "f"], "Fox"), ("sample_000004", "Animals/Land/Fox", True, ["a", "x", "l", "f"], "Fox"),
    ]


def test_forced_resample_and_overrides(spark):
    rows = [(["R"], [1], None, []), (["R", "A"], [1, 1], 1, []), (["R", "B"], [1, 2], 0, [])]
    nodes = tree(spark, rows)
    plan = TH.theme_quota_plan(nodes, {"R": 3}, {"category": 9})
    assert {r.node: r.residual for r in plan.collect()} == {"R": 2, "R/A": 1, "R/B": 0}
    draws = TH.draw_themes(nodes, plan).collect()
    assert sorted(r.resampled for r in draws) == [False, True, True]
    with pytest.raises(ValueError):
        TH.require_quota(TH.theme_quota_plan(tree(spark, [(["R"], [1], None, [])])))
    with pytest.raises(ValueError):
        TH.theme_quota_plan(nodes, None, {"galaxy": 1})


def test_large_quota_is_chunked(spark, monkeypatch):
    monkeypatch.setattr(TH, "DRAW_CHUNK", 7)
    nodes = tree(spark, [(["R"], [1], 50, []), (["R", "A"], [1, 1], None, []), (["R", "B"], [1, 2], None, [])])
    rows = TH.draw_themes(nodes, TH.theme_quota_plan(nodes)).collect()
    assert sorted(r.seq for r in rows) == list(range(1, 51)) and Counter(r.resampled for r in rows) == {True: 48, False: 2}


# --- realizations ---------------------------------------------------------------------
def test_attempt_loop(spark):
    rows = [("a", 1, ["e"]), ("a", 2, []), ("a", 3, ["late"]), ("b", 1, ["e", "e"]), ("b", 2, ["f"]), ("c", 1, ["g"])]
    df = spark.createDataFrame(rows, "case_id string, attempt int, synthesis_errors array<string>")
    df = df.withColumns({"guard_errors": F.col("synthesis_errors"), "verdict_issues": F.lit(None).cast("array<string>"), "verdict_feedback": F.when(F.col("case_id") == "c", F.array(F.lit("hint")))})
    out = RZ.accept_realizations(df, 2)
    assert [(r.case_id, r.attempt) for r in out["accepted"].collect()] == [("a", 2)]
    assert [(r.case_id, r.attempt, list(r.errors)) for r in out["rejected"].collect()] == [("b", 2, ["f"])]
    assert [(r.case_id, r.next_attempt, list(r.feedback)) for r in out["retry"].collect()] == [("c", 2, ["hint"])]
    assert out["raw"].count() == 3
