"""Repeated passages, periodic runs and importance draws against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from benchloom.llm import anchors, periods, queries, resampling
from benchloom.llm.words import starts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, n_words string, block int, runs int, rank string"


def table(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- repeated passages -------------------------------------------------------------------------


def stripped(rows, window=13):
    """For each row (words, removed places)."""
    least: dict[tuple, int] = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (doc_id, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            first = least.get(tuple(w[i : i + window]))
            if first is not None and (doc_id is None or first < doc_id):
                gone.update(range(i, i + window))
        out.append((w, gone))
    return out


def passage_rows(result):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in result.collect())


def expected_passages(rows, window=13):
    return Counter((d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (d, _), (w, g) in zip(rows, stripped(rows, window), strict=True))


def random_docs(seed, n, null_ids=True):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(pool)
                a = rng.randint(0, len(p) - 1)
                words += p[a : a + rng.randint(1, 40)]
            else:
                words += [rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 9))]
        doc_id = None if null_ids and rng.random() < 0.1 else rng.choice([i, i, rng.randint(0, n), -i, 2**63 - 1 - i, -(2**63) + i])
        rows.append((doc_id, rng.choice([" ", "\t", "\n "]).join(words) if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 700)  # many blocks, so that they must ask each other
    rows = random_docs(seed, 150)
    assert passage_rows(anchors.remove_repeats(table(spark, rows))) == expected_passages(rows)


def test_passages_of_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 300)
    rows = random_docs(3, 80)
    for window, period, cover in ((5, 3, (0, 1)), (3, 1, (0,)), (7, 7, (0, 1, 3))):
        assert passage_rows(anchors.remove_repeats(table(spark, rows), window=window, period=period, cover=cover)) == expected_passages(rows, window)
    with pytest.raises(ValueError):
        anchors.remove_repeats(table(spark, rows), cover=(0, 1, 2))


def test_passages_odd_rows(spark):
    p = " ".join(f"w{k}" for k in range(20))
    rows = [(5, p), (5, p), (3, "\x0b" + p.replace(" ", "\r\n")), (None, p), (None, p), (9, None), (8, ""), (7, "   "), (6, "w1 w2"), (2, "é\x85" * 5), (4, "x " + p[3:] + " " + p)]
    rows += [(1, "z " * 30_000 + p), (11, "z " * 40_000)]
    assert passage_rows(anchors.remove_repeats(table(spark, rows))) == expected_passages(rows)
    got = {r.doc_id: r.removed for r in anchors.remove_repeats(table(spark, [(1, p), (2, "a b " + p + " c " + p)])).collect()}
    assert got[1] == [] and [tuple(s) for s in got[2]] == [(2, 22), (23, 43)]
    assert anchors.remove_repeats(table(spark, []).limit(0)).collect() == []


def test_passages_one_text_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 2000)
    p = " ".join(f"w{k}" for k in range(30))
    rows = [(k, p if k % 3 else f"{k} " + " ".join(f"{k}u{j}" for j in range(20))) for k in range(300)]
    assert passage_rows(anchors.remove_repeats(table(spark, rows))) == expected_passages(rows)


def test_passages_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op11_difference_cover(spark, small).collect()}
    want = {d: (len(w), len(g), sha(" ".join(x for i, x in enumerate(w) if i not in g))) for (d, _), (w, g) in zip(rows, stripped(rows), strict=True)}
    assert got == want and sum(x[1] for x in got.values()) > 0


# --- periodic runs -----------------------------------------------------------------------------


def longest_lyndon(s):
    n = len(s)
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(j - i for j in range(i + 1, n + 1) if is_lyndon(s[i:j])) for i in range(n)]


def all_runs(s, least=6, powers=4):
    found = []
    for p in range(1, len(s) // powers + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, powers * p) and not any(all(s[x] == s[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                found.append((i, length, p))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_lyndon_arrays():
    rng = random.Random(4)
    for _ in range(400):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 14))]
        assert periods.lyndon_array(s) == longest_lyndon(s)
        assert periods.lyndon_array([-c for c in s]) == longest_lyndon([-c for c in s])


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            root = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
            texts.append([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] + root * rng.randint(0, 8) + root[:2] + [rng.randint(0, 2) for _ in range(rng.randint(0, 30))])
        starts = starts_of(np.array([len(t) for t in texts]))
        ids = np.array([x for t in texts for x in t], np.int64)
        for least, powers in ((6, 4), (2, 2), (3, 3)):
            got = list(zip(*(x.tolist() for x in periods.runs_of(ids, starts, least, powers)), strict=True))
            assert got == [(i + int(starts[k]), n, p) for k, t in enumerate(texts) for i, n, p in all_runs(t, least, powers)]


def test_runs_odd_rows(spark):
    rows = [(1, "a " * 50_000), (2, None), (3, ""), (4, " \n"), (None, "b c " * 9), (None, "b c " * 9), (5, "a b c d"), (5, "x y y y y y y z"), (6, "p q r\x0b" * 3 + "p q"), (7, "A a " * 5 + "a a a a a a")]
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periods.find_runs(table(spark, rows)).collect())
    want = Counter()
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = all_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        want[doc_id, len(words), tuple(runs), collapsed(words, runs)] += 1
    assert got == want
    assert periods.find_runs(table(spark, []).limit(0)).collect() == []


def test_runs_query(spark, small):
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        words, h = WORD.findall(r.text or ""), crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = all_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        want[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(words, runs)))
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op12_word_runs(spark, small).collect()}
    assert got == want and sum(x[0] for x in got.values()) > 5


# --- importance draws --------------------------------------------------------------------------

NORMAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = NORMAL_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """Rows (doc_id, n_features, weight, score, rank), those of equal rows in one order."""
    bucket = lambda x: crc32(x.encode()) % buckets
    own = [features(t, longest) for _, t in docs]
    s, t = Counter(bucket(x) for _, f in own for x in f), Counter(bucket(x) for text in target for x in features(text, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + float(buckets)) / ((s[b] + 1.0) * (t.total() + float(buckets)))))
    rows = []
    for (doc_id, _), (words, f) in zip(docs, own, strict=True):
        h = int(sha(f"{seed}:{'null' if doc_id is None else doc_id}")[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in rows)


def test_crcs_from_prefixes():
    rng = random.Random(6)
    docs = [[bytes(rng.choices(b"abcz09\xc3\xa9", k=rng.choice([1, 3, 9, 300, 70_000]))) for _ in range(rng.randint(0, 12))] for _ in range(20)]
    owner, crcs = resampling.feature_crcs([resampling.running_crcs(d) for d in docs], 4)
    want = [(k, crc32(b" ".join(d[i : i + n]))) for n in range(1, 5) for k, d in enumerate(docs) for i in range(len(d) - n + 1)]
    assert list(zip(owner.tolist(), crcs.tolist(), strict=True)) == want
    assert resampling.feature_crcs([], 2)[0].tolist() == []


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 97, 45)])
def test_draw_against_brute_force(spark, longest, buckets, percent):
    rng = random.Random(7)
    words = ["Ab", "c-d", "é", "x1", "Zz,", "日本", "q"]
    docs = [(rng.choice([k, k, None, 5]), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(120)] + [(500, None), (501, ""), (502, ".,-")]
    docs += [(600, docs[0][1])] * 3 + [(7, "w " * 60_000)]
    target = [" ".join(rng.choices(words[:4], k=30)), None, "ab é"]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(table(spark, docs), aim, longest=longest, buckets=buckets, percent=percent)
    assert Counter(map(tuple, got.collect())) == drawn(docs, target, longest, buckets, percent)


def test_draw_empty_tables(spark):
    empty = table(spark, []).limit(0)
    assert resampling.resample(empty, empty).collect() == []
    some = table(spark, [(1, "a b"), (None, None)])
    assert Counter(map(tuple, resampling.resample(some, empty).collect())) == drawn([(1, "a b"), (None, None)], [])


def test_draw_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.op13_prefix_crc(spark, small).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == drawn(docs, target)
