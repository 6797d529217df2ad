"""Near duplicates, search, classification, archives and the pipeline against brute force and odd rows."""

import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from benchloom.llm import common, langid, postings, pstable, queries, simhash, toxicity, warc
from benchloom.session import scratch_path

ODD = "doc_id bigint, text string, lang string, source string, node string, fp int"


def components(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components_of_chains_and_stars(frame):
    rng = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)] + [(5, 5)]
    want = {k: r for k, r in enumerate(components(300, pairs)) if any(k in p for p in pairs)}
    assert {r.node: r.root for r in common.components(frame(pairs, "a bigint, b bigint")).collect()} == want
    assert common.components(frame([], "a bigint, b bigint")).count() == 0


def simple_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", "  \n", "one", "One", "two words", "Ünï Ä b c d\x0be", "w " * 70_000, "a b c d e f g h i j", "A b c d\te f g h i j"]


def test_fingerprints():
    assert [simhash.fingerprint(t) for t in TEXTS] == [simple_print(t) for t in TEXTS]


def test_masks_cover_every_flip():
    rng = np.random.default_rng(2)
    tables = [m % (1 << 64) for m in simhash.masks(4)]
    assert len(tables) == 31 and all(24 <= m.bit_count() <= 40 for m in tables)
    for _ in range(3000):
        flip = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
        assert any(flip & m == 0 for m in tables)


@pytest.mark.parametrize("cell", [3, 4096])
def test_links_within_radius(frame, monkeypatch, cell):
    """Both ways of searching a bucket give the components of all pairs."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng, prints = np.random.default_rng(3), set()
    for base in rng.integers(0, 1 << 63, 12):
        for _ in range(15):
            prints.add(int(base) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 4])
    found = common.components(simhash.links(frame([(0, p) for p in prints], "k int, fp bigint")))
    got = {p: p for p in prints} | {r.node: r.root for r in found.collect()}
    assert [got[p] for p in prints] == [prints[r] for r in want]


def test_near_duplicates_odd_rows(frame):
    rows = [(k, t, "en", "s", "x", 1) for k, t in enumerate(TEXTS)] + [(None, "lonely text here with words", None, None, None, None), (3, "one", "en", "s", "x", 1), (None, None, None, None, None, None)]
    docs = frame(rows, ODD)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{simple_print(t):016x}") for i, t, *_ in rows)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[4] == 3 and by[8] == by[9] == 8 and by[5] == 5
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 3, 5, 6, 7, 8, None])
    assert simhash.near_duplicates(frame([], ODD)).count() == 0 and simhash.keep_one(frame([], ODD)).count() == 0


def test_several_prints_link_more(frame):
    """Each pair within the radius in any print is in one component, by brute force."""
    rng = np.random.default_rng(8)
    base = [list(rng.choice(["ka", "lo", "mi", "ra", "tu", "ne", "so", "pi"], 120)) for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.02 else "zz" for w in b) for b in base for _ in range(5)]
    prints = [simhash.fingerprints(t, 3, prints=4) for t in texts]
    near = lambda a, b: any((x ^ y).bit_count() <= 4 for x, y in zip(a, b, strict=True))
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near(prints[i], prints[j])])
    docs = frame([(k, t, None, None, None, None) for k, t in enumerate(texts)], ODD)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=3, prints=4).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert {r.doc_id for r in simhash.keep_one(docs, shingle=3, prints=4).collect()} == set(want)
    assert simhash.near_duplicates(frame([], ODD), prints=4).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v int, links int"


def vector_rows(rng, n=400):
    base = rng.standard_normal((n // 8, 16))
    x = np.vstack([base[rng.integers(0, len(base), n // 2)] + 0.03 * rng.standard_normal((n // 2, 16)), rng.standard_normal((n // 2, 16))])
    rows = [(k, [float(np.float32(y)) for y in row], k % 3, "a", 1, 2) for k, row in enumerate(x)]
    rows += [(n + k, rows[7][1], 0, "a", 1, 2) for k in range(5)] + [(7, rows[7][1], 0, "a", 1, 2)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 5]
    return rows, [(100_000 + 20 * k, v, None, None, None, None) for k, v in enumerate(odd)]


@pytest.mark.parametrize("chunk", [8, 2048])
def test_pstable_brute_force(frame, monkeypatch, chunk):
    monkeypatch.setattr(pstable, "CHUNK", chunk)
    rows, odd = vector_rows(np.random.default_rng(4))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    order = sorted(range(len(rows)), key=lambda k: ids[k])
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near[order[i], order[j]]])
    comp = {order[k]: ids[order[r]] for k, r in enumerate(root)}
    want = Counter((ids[k], int(near[k].sum()), comp[k], ids[k] == comp[k]) for k in range(len(rows)))
    got = pstable.near_duplicates(frame(rows + odd + [(None, rows[7][1], 1, None, 1, 1)], VECTORS), miss=1e-9).collect()
    assert Counter(tuple(r) for r in got if r.vec_id is not None and r.vec_id < 100_000) == want
    assert {tuple(r) for r in got if r.vec_id is None or r.vec_id >= 100_000} == {(r[0], 0, r[0], True) for r in odd} | {(None, 0, None, True)}
    assert pstable.near_duplicates(frame([], VECTORS)).count() == 0


def test_postings(frame, monkeypatch):
    monkeypatch.setattr(postings, "CHUNK", 50)
    rows, odd = vector_rows(np.random.default_rng(5), 2000)
    got: dict = {}
    for r in postings.search(frame(rows + odd, VECTORS), every=20, top=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {r[0] for r in rows if r[0] % 20 == 0}
    table = {r[0]: np.array(r[1]) for r in rows}
    ids = np.array(sorted(table))
    x, hits = np.array([table[k] for k in ids]), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 8)) and q not in [f[1] for f in found]
        assert all(abs(s - table[v] @ table[q]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        s = np.where(ids == q, -np.inf, (x * table[q]).sum(1))
        hits += len({f[1] for f in found} & set(ids[np.lexsort((ids, -s))[:7]].tolist()))
    assert hits >= 0.9 * 7 * len(got)
    assert postings.search(frame([], VECTORS)).count() == 0
    few = postings.search(frame(rows[:3], VECTORS)).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
        return row[-1]

    rng, terms = np.random.default_rng(6), ["idiot", "moron", "worthless", "scum", "clown", "disgusting"]
    own = toxicity.Automaton(terms, ["lowei"])
    for _ in range(4000):
        word = list(rng.choice(terms + ["loweiung", "lowe"]))
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(0, len(word) + 1))
            word[k : k + int(rng.integers(0, 2))] = list(rng.choice(["", "x", "o", "s"]))
        word = "".join(word)
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.allowed(t)]
        got = own.match(word)
        if near and min(near)[0] == 0:
            assert got == (word, 0)
        elif word.startswith("lowei"):
            assert got == ("lowei", 0)
        else:
            assert got == ((min(near)[1], min(near)[0]) if near else None), word


def toxic_corpus(n=600):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ra", "tu", "ne"], rng.integers(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        words = list(rng.choice(vocabulary, rng.integers(10, 60)))
        if k % 8 == 0:
            for t in rng.choice(["grumpus", "snarkel", "bleffing"], 2):
                words.insert(int(rng.integers(0, len(words))), str(t))
        rows.append((k, " ".join(words) + ".", "en", "s", "x", 1))
        labels.append((k, int(k % 8 == 0), 1))
    return rows, labels


def test_toxicity_learns_and_catches_misspellings(frame):
    rows, labels = toxic_corpus()
    odd = [(5000, None, None, None, None, None), (5001, "", "en", "s", "x", 1), (None, "the grumpus", "en", "s", "x", 1), (5002, "ka lo. " * 30_000 + "snarkel grumpus bleffing", "en", "s", "x", 1), (5003, "such a grumpos and snarkl, bleffing", "en", "s", "x", 1)]
    docs, marks = frame(rows + odd, ODD), frame(labels + labels[:3] + [(None, 1, 1), (9, None, 1)], "doc_id bigint, toxic int, text int")
    model = toxicity.learn(docs, marks)
    assert {"grumpus", "snarkel", "bleffing"} <= set(model.terms)
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    assert all(got[k].predicted == t for k, t, _ in labels) and got[5002].predicted == got[5003].predicted == got[None].predicted == 1
    assert got[5000].predicted == got[5001].predicted == 0 and got[5000].score == got[5001].score and not got[None].held_out
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None)
    hits = docs.filter("doc_id = 5003").select(toxicity.hits(docs.text, model).alias("h")).first().h
    assert [(h.term, h.distance) for h in hits] == [("grumpus", 1), ("snarkel", 1), ("bleffing", 0)]
    nothing = toxicity.learn(docs, frame([], "doc_id bigint, toxic int"))
    assert len({r.score for r in toxicity.classify(docs, nothing).collect()}) == 1
    assert toxicity.classify(frame([], ODD), model).count() == 0


def test_quotation_window():
    own = toxicity.Scanner(toxicity.Model({"grumpus": 5.0}, {}))
    quoted = lambda text: [h[4] for h in own.hits(text)]
    assert quoted('she said he is a grumpus') == [True] and quoted('the sign read "beware of the grumpus here" again') == [True]
    assert quoted("you grumpus") == [False] and quoted("grumpus " + "ka " * 20 + "said") == [False]
    assert own.score('they wrote "grumpus" there') < own.score("you grumpus")


def test_language_held_out(spark, frame, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.learn(docs)
    found = langid.classify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.9 * len(found)
    long = " ".join(r.text for r in docs.filter("lang = 'fr'").limit(20).collect()) * 5
    odd = frame([(1, None, None, None, "x", 1), (2, "", "en", "s", "x", 1), (3, "12 -- 34 _", "en", "s", "x", 1), (4, long, "en", "s", "x", 1), (None, long, None, None, None, None)], ODD)
    got = langid.classify(odd, model).collect()
    assert sorted(((r.doc_id or 0), r.lang_pred, 0 <= r.score <= 1) for r in got) == [(0, "fr", True), (1, "und", True), (2, "und", True), (3, "und", True), (4, "fr", True)]
    empty = frame([], ODD)
    assert langid.classify(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.classify(odd, langid.learn(empty)).collect()} == {"und"}


def test_kernel_is_shared_presence():
    rows = [langid.presence(t) for t in ("abc abd", "abd", "xyz")]
    grams = lambda t: {f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    assert [int(r.sum()) for r in rows] == [len(grams(t)) for t in ("abc abd", "abd", "xyz")]
    assert int((rows[0] & rows[1]).sum()) == len(grams("abc abd") & grams("abd"))
    assert langid.presence("é" * 200_000).sum() == len(grams("é" * 50))


PAGES = "page_id bigint, url string, html string, digest string, top int"


def test_warc_round_trip(spark, frame, tmp_path):
    long, short = "<p>é</p>" * 300, "<p>short</p>"
    rows = [(1, "http://a", long, "x", 1), (2, "http://b\r\nX: y", long, "x", 1), (9, None, long, "x", 1), (9, None, long, "x", 1), (3, "u", short, "x", 1), (4, "u", short, "x", 1), (5, "u", None, None, None), (None, "u", long, None, None), (None, "u", "", None, None), (6, "u", "big " * 500_000, "x", 1)]
    path = scratch_path(spark, "test-warc")
    warc.write_pages(frame(rows, PAGES), path)
    want = Counter()
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        again = html == long and i != 9
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None] += 1
    assert Counter(map(tuple, warc.read_pages(spark, path).collect())) == want
    heads = spark.read.format("warc").option("payload", "false").load(path)
    some = heads.filter("record_type = 'revisit' and target_uri like 'http://a%' and refers_to is not null")
    assert [(r.payload, r.payload_length) for r in some.collect()] == [(None, len(long.encode()))]
    assert heads.filter("not record_type = 'warcinfo' and payload_length > 1000000").count() == 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "record_type" not in plan.split("Filter")[1].split("\n")[0]
    empty = scratch_path(spark, "test-warc")
    warc.write_pages(frame([], PAGES), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_warc_foreign_files(spark, tmp_path):
    """Plain files and gzip members without lengths."""
    record = lambda k: warc.page_record({"record_type": "response", "record_id": f"<urn:x-page:{k}>", "target_uri": "u", "date": None, "payload_digest": None, "refers_to": None, "payload_length": 5000, "payload": b"%05d" % k * 1000})
    (tmp_path / "a.warc").write_bytes(b"".join(map(record, range(3))))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(k)) for k in range(3, 6)))
    warc.register(spark)
    for flag in ("true", "false"):
        got = spark.read.format("warc").option("payload", flag).load(f"file://{tmp_path}").filter("record_id <> '<urn:x-page:1>'").collect()
        assert {r.record_id for r in got} == {f"<urn:x-page:{k}>" for k in (0, 2, 3, 4, 5)}
        assert all(r.payload_length == 5000 for r in got)
        if flag == "true":
            assert all(bytes(r.payload)[:5] == b"%05d" % int(re.findall(r"\d+", r.record_id)[0]) and len(r.payload) == 5000 for r in got)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.cut(stage(spark, at, small), "test-stage")
        if name == "simhash_near_dedup":
            rows = sorted((r.doc_id, r.text) for r in at.collect())
            groups = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(rows[i][1], rows[j][1]) >= corpus_pipeline.DEDUP_SIMILARITY])
            assert {r.doc_id for r in after.collect()} == {rows[k][0] for k in groups}
        if name != "byte_bpe":
            assert after.columns == docs.columns and after.count() > 0
            at = after
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in at.collect())
    assert corpus_pipeline.run(spark, small).count() == after.count()


@pytest.mark.parametrize("name", ["op2_covering_simhash", "op4_language_id", "op7_toxicity", "op5_pstable_dedup"])
def test_registered_queries_give_a_row_each(spark, small, name):
    source = "embeddings" if "op5" in name else "documents"
    assert queries.QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{source}.parquet").count()


def test_keep_one_null_and_repeated_ids(frame):
    """Every group keeps one row, whatever the ids."""
    own = [" ".join(f"{name}{k}" for k in range(40)) for name in ("p", "q", "r", "s", "t", "u")]
    rows = [(None, own[0]), (None, own[0]), (None, own[1]), (None, own[2]), (4, own[2]), (7, own[3]), (7, own[4]), (7, own[4]), (7, own[5]), (2, own[5])]
    docs = frame([(i, t, None, None, None, None) for i, t in rows], ODD)
    want = Counter([(None, own[0]), (None, own[1]), (4, own[2]), (7, own[3]), (7, own[4]), (2, own[5])])
    for similarity in (None, 0.8):
        kept = simhash.keep_one(docs, similarity=similarity)
        assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == want


def alike(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def families(rng, n=24, words=150):
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(vocabulary, words)) for _ in range(n)]
    change = lambda b, share: " ".join(w if rng.random() > share else f"x{rng.integers(10**6)}" for w in b)
    return [change(b, share) for b in base for share in (0, 0.005, 0.01, 0.02, 0.02, 0.025, 0.03, 0.05)]


def test_dedup_stage_links_by_shingle_similarity(spark, frame):
    """The groups of the stage are those of all pairs at 0.8, near the bound too; a chain through a shared bucket holds."""
    texts = families(np.random.default_rng(9))
    texts += [texts[0].upper(), "a b", "A  b", "a c", "one two three four five", "one two three four six"]
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8])
    docs = frame([(k, t, None, None, None, None) for k, t in enumerate(texts)], ODD)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(want))
    assert corpus_pipeline.drop_near_duplicates(spark, frame([], ODD), "").count() == 0


def test_unsure_buckets_are_searched(frame):
    """All pairs of a bucket count, not only those with its smallest member."""
    sets = [(1, range(0, 100)), (2, range(30, 130)), (3, range(35, 135)), (4, range(40, 140)), (5, range(500, 600))]
    lists = frame([([(c, list(s)) for c, s in sets],)], "m array<struct<c:bigint,s:array<bigint>>>")
    (row,) = lists.select(simhash._walk_sets(0.8)("m").alias("e")).collect()
    assert {tuple(sorted(e)) for e in row.e} == {(2, 3), (2, 4)}


def test_sketches_rule_out_pairs_but_no_alike_one(spark, frame, monkeypatch):
    """Whole sets move for texts that may be alike only; the keys of the covering tables move once."""
    labels, jobs = Counter(), []
    real = simhash.cut

    def counted(df, label):
        out = real(df, label)
        labels[label] += out.count()
        if label == "buckets":
            jobs.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    shared = [f"s{k}" for k in range(60)]
    texts = [" ".join(shared + [f"t{i}w{k}" for k in range(30)]) for i in range(40)]  # alike to about 0.46, so many share a band
    texts += [texts[0] + " more", texts[1] + " words"]
    docs = frame([(k, t, None, None, None, None) for k, t in enumerate(texts)], ODD)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert labels["pairs"] > 2 and labels["sets"] <= 8
    assert any("REPARTITION_BY_COL" in plan for plan in jobs)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(13)
    for n in (0, 1, 50, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 20, np.uint64)]))
        assert np.bitwise_count(simhash.sketch(a).view(np.uint64) ^ simhash.sketch(b).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_dedup_stage_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(rows[i][1], rows[j][1]) >= 0.8])
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()} == {rows[k][0] for k in want}


def test_language_stage_rests_on_the_score(spark, frame, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rng = np.random.default_rng(10)
    noise = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz  "), 400)) for _ in range(20)] + ["жшщ цчъ ыьэ " * 20, None, "12 34"]
    both = docs.unionByName(frame([(10_000 + k, t, None, "x", 1) for k, t in enumerate(noise)], docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, both, small).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
    odd = frame([(1, "some words", None, None, "x", 1), (2, None, None, None, "x", 1), (None, "é", "en", None, None, None), (3, "12 _", None, None, None, None)], ODD)
    assert {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, odd, small).collect()} == {1, None}


def test_vectors_of_two_lengths(frame, monkeypatch):
    monkeypatch.setattr(postings, "CHUNK", 100)
    rng = np.random.default_rng(8)
    long, short = rng.standard_normal((300, 12)), rng.standard_normal((40, 5))
    short[20:] = short[:20] * 2  # parallel: cosine 1
    x = {k: v for k, v in enumerate([*long, *short])}
    table = frame([(k, [float(np.float32(y)) for y in v], 0, "a", 1, 2) for k, v in x.items()], VECTORS)
    x = {k: np.array(v, np.float32).astype(float) for k, v in x.items()}
    links = {r.vec_id: (r.n_links, r.component_id) for r in pstable.near_duplicates(table).collect()}
    assert all(links[300 + k] == (1, 300 + k % 20) for k in range(40))
    assert set(links) == set(x) and all(links[k][0] == 0 for k in range(300))
    got: dict = {}
    for r in postings.search(table, every=20, top=6).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 340, 20))
    for q in (300, 320):  # a length of few rows is searched whole
        others = sorted((k for k in x if k >= 300 and k != q), key=lambda k: (-float((x[k] * x[q]).sum()), k))
        assert sorted(got[q]) == sorted(others[:6])
    assert all(v < 300 for q in range(0, 300, 20) for v in got[q])


def test_postings_copies_and_share_read(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = table.selectExpr("vec_id id", "cast(embedding as array<double>) v").filter("v is not null")
    x = np.array([r.v for r in rows.collect()])
    norm2 = float((x * x).sum(1).max())
    index = postings.build(rows, len(x), x.shape[1], norm2)
    placed = postings.lists_of(index, postings.lift(x, norm2).astype(np.float32))
    assert (placed >= 0).sum(1).mean() > 1  # boundary vectors stand in several lists
    assert all(len(set(p[p >= 0])) == (p >= 0).sum() for p in placed)
    queries = np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)
    for k, read in enumerate(postings.lists_read(index, queries)):  # the walk misses hardly a centroid in reach
        d = postings.distances(queries[k : k + 1], index.centroids)[0]
        assert len(set(np.flatnonzero(d <= index.limit(d.min()))) - set(read)) <= max(1, 0.05 * len(d))


def test_language_stage_keeps_a_language_without_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for lang in ("en", "de"):
        hidden = docs.withColumn("lang", F.when(F.col("lang") != lang, F.col("lang")))
        kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, hidden, small).collect()}
        assert kept == {r.doc_id for r in docs.collect()}


def test_language_bound_holds_for_a_repeated_id(frame):
    texts = [f"{a} {b} words of a text" for a in ("one", "two", "ten") for b in ("red", "blue", "green")]
    rows = [(1, t, "en", None, None, None) for t in texts * 20] + [(2 + k, f"ein satz mit wort {k}", "de", None, None, None) for k in range(40)]
    model = langid.learn(frame(rows, ODD), rows_per_lang=10, landmarks=64)
    assert model.langs == ["de", "en"] or model.langs == ["de"]  # id 1 may be held out
    assert len(model.landmarks) <= 10 + 1  # ten of one language, the repeated id once


def test_babble():
    rng = np.random.default_rng(12)
    random = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz  "), 800))
    assert langid.babble(random) and langid.babble(random + " 123") and langid.babble("la lo " * 50)
    assert not any(langid.babble(t) for t in (None, "", "12", "ab", "a short text", random + " " + random, "the cat and the dog and the bird sat on the mat " * 5))


def test_a_sketching_worker_lets_the_model_before_go(spark):
    """The pipeline's workers come from language identification with its model, which the sketches do not need."""
    one = spark.range(1).selectExpr("cast(id as string) text").coalesce(1)
    ask = lambda fn: one.select(fn("text").alias("x")).collect()[0].x

    @F.udf("string")
    def hold(text):
        return common.held("model", lambda: text)

    @F.udf("string")
    def holds(text):
        return str(common._HELD and common._HELD[0][0])

    assert ask(hold) == "0" and ask(holds) == "model"
    one.select(simhash._sketched(F.col("text"), 3, 1)).collect()
    assert ask(holds) == "None"
