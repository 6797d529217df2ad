"""Token codes, sharding, mixing and prefix BPE against literal or brute-force versions."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from benchloom.llm import dac, jump, mixing, prefix_bpe, queries
from benchloom.session import scratch_path

ODD = "doc_id bigint, text string, source string, start string, shard int, block int"
ROWS = [
    (3, "The quick brown fox\n jumps  over\tit", "a", "x", 1, 2),
    (1, None, None, None, None, None),
    (2, "", "b", "x", 1, 2),
    (None, "no id", "b", "x", 1, 2),
    (3, "The quick brown fox\n jumps  over\tit", "a", "x", 1, 2),
    (-5, "été ßü 日本語 🙂 <|endoftext|> 12345  x\r\n\r\n  y ", None, "x", 1, 2),
    (7, "word " * 40_000 + "x" * 3000, "a", "x", 1, 2),
]
BYTE = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    return tokenizer


def codes(spark, docs):
    path = scratch_path(spark, "test-codes")
    dac.write_segments(docs, path, BYTE, segment_tokens=500)
    return dac.read_segments(spark, path)


def test_codes_round_trip(spark, frame, plain):
    segments = codes(spark, frame(ROWS, ODD)).cache()
    got = sorted(map(tuple, dac.document_digests(segments).collect()), key=lambda r: r[1])
    want, start, everything = [], 0, []
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
        everything += ids
    assert got == want
    asked = [0, 1, start - 1, start // 2, start, -1, start // 3]
    found = dac.tokens_at(segments, frame([(p,) for p in asked], "position bigint")).collect()
    assert {r.position: r.token for r in found} == {p: everything[p] for p in asked if 0 <= p < start}


def test_codes_empty_table(spark, frame):
    assert dac.document_digests(codes(spark, frame([], ODD))).count() == 0


def test_segment_random_access():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 32, 5001, dtype=np.uint32) >> rng.integers(0, 32, 5001, dtype=np.uint32)
    own = dac.Segment(dac.pack_segment([1, None], [10, 4991], ids))
    where = rng.permutation(5001)
    assert (own.all() == ids).all() and (own.at(where) == ids[where]).all()


def jump_hash(key, buckets):
    key, b, j = key % 2**64, -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_matches_published_generator(spark, frame):
    keys = [0, 1, 256, -1, 2**63 - 1, -(2**63), 123456789012345, *range(1000, 1200)]
    df = frame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 17, 1024, 5000):
        got = {r.k: r.b for r in df.select("k", jump.jump_bucket(df.k, n).alias("b")).collect()}
        assert got == {k: jump_hash(k, n) for k in keys}


def test_shards_brute_force(frame):
    got = jump.assign(frame(ROWS, ODD), 4).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump_hash(i or 0, 4), jump_hash(i or 0, 5)) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 4) and r.law == "key" for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jump.assign(frame([], ODD), 4).count() == 0


def mixture(rows, ratio, seed=mixing.SEED, block=mixing.BLOCK_TOKENS):
    """The mixture dealt row by row."""
    import re

    tokens = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for i, t, s, *_ in rows]
    totals = Counter()
    for _, s, n in tokens:
        totals[s] += n
    budget = sum(totals.values())
    p = {s: n / budget for s, n in totals.items()}

    def entropy(a):
        z = sum(x**a for x in p.values())
        return -sum(x**a / z * math.log(x**a / z) for x in p.values())

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= ratio * math.log(len(p)) else (low, mid)
    a = 1.0 if entropy(1) >= ratio * math.log(len(p)) else low
    z, out = sum(x**a for x in p.values()), Counter()
    for s, n in totals.items():
        allotted, at, epoch = round(p[s] ** a / z * budget), 0, 0
        while at < allotted:
            place = lambda i: int(hashlib.md5(f"{seed}:{epoch}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
            for i, _, k in sorted((x for x in tokens if x[1] == s), key=lambda x: (place(x[0]), x[0] or 0, x[2])):
                if at < allotted:
                    out[i, s, epoch, place(i)] += 1
                at += k
            epoch += 1
    return out


def test_mixture_brute_force(frame):
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 3 else ("mid" if i % 2 else None), None, None, None) for i in range(300)]
    rows += [(1000 + i, "w", "tiny", None, None, None) for i in range(3)]
    for ratio in (0.8, 0.97, 1.0):
        r, totals = mixing.source_totals(frame(rows, ODD))
        got = mixing.realise(r, mixing.weights(totals, entropy=ratio)).collect()
        assert Counter((x.doc_id, x.source, x.epoch, x.draw) for x in got) == mixture(rows, ratio)
    copies = Counter(x.doc_id for x in mixing.mix(frame(rows, ODD), entropy=1.0).collect())
    assert copies == Counter(x.doc_id for x in got)


def test_mixture_odd_rows(frame):
    docs = frame(ROWS, ODD)
    mixed = mixing.mix(docs, repetitions=3.0)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(frame([], ODD), entropy=0.5).count() == 0
    plan = {r.source: r for r in mixing.weights(mixing.source_totals(docs)[1], repetitions=1.5).collect()}
    assert all(r.allotted <= 1.5 * r.tokens + 1 for r in plan.values()) and abs(sum(r.weight for r in plan.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        mixing.weights(docs)


@pytest.fixture(scope="module")
def ranks():
    return prefix_bpe.Ranks.load(MULTI)


@pytest.fixture(scope="module")
def reference_bpe(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_prefix_bpe_rows(frame, reference_bpe):
    docs = frame(ROWS, ODD)
    got = prefix_bpe.encode(docs, MULTI, public_tokenizers.PATTERN)
    got = [(r.doc_id, list(r.ids), bytes(r.d)) for r in got.withColumn("d", prefix_bpe.decode(got.ids, MULTI)).collect()]
    want = [(i, reference_bpe.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = prefix_bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in again), key=str) == sorted(want, key=str)


def test_prefix_bpe_random_texts(ranks, reference_bpe):
    own, rng = prefix_bpe.TextEncoder(ranks, public_tokenizers.PATTERN), np.random.default_rng(3)
    letters = list("aeintr ETß日é1 .,\n\t'  s \x1c")
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert np.frombuffer(own.encode(text), np.int32).tolist() == reference_bpe.encode_ordinary(text), repr(text)


def test_prefix_table_appends_and_edits(ranks):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("theinraoé"), n)).encode()
    for _ in range(40):
        first, more = word(200), word(30)
        own = prefix_bpe.PrefixTable(ranks, first)
        own.append(more)
        whole = prefix_bpe.PrefixTable(ranks, first + more)
        assert own.last == whole.last and whole.ids() == ranks.merge(first + more)
        assert whole.ids(100) == ranks.merge((first + more)[:100])
        start = int(rng.integers(0, 150))
        end, new = start + int(rng.integers(0, 40)), word(int(rng.integers(0, 20)))
        own.replace(start, end, new)
        data = (first + more)[:start] + new + (first + more)[end:]
        assert own.data == data and own.ids() == ranks.merge(data)


def test_text_edits(ranks):
    own, rng = prefix_bpe.TextEncoder(ranks, public_tokenizers.PATTERN), np.random.default_rng(6)
    text = "".join(rng.choice(list("abc  \n.1'st"), 400))
    for _ in range(200):
        a = int(rng.integers(0, 390))
        b, new = a + int(rng.integers(0, 10)), "".join(rng.choice(list("abc \n."), rng.integers(0, 6)))
        after, spans, _ = own.edit(text, a, b, new)
        assert spans == [m.span() for m in own.pattern.finditer(after)]


def test_registered_queries_read_all_rows(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op1_token_codes", "op8_jump_shards", "op10_prefix_bpe"):
        assert queries.QUERIES[name](spark, small).count() == n


def test_op1_gives_added_tokens_their_id(spark, frame):
    """The query's ids are those of the library's plain call, texts with the literal of an added token too."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE)
    texts = ["a plain text", "ends here <|endoftext|> and on", "<|endoftext|>", "word<|endoftext|>word word", "last words"]
    folder = scratch_path(spark, "test-op1")
    frame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    want, start = [], 0
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, dac.END_ID]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op1_token_codes(spark, folder).collect())) == want
