"""SimHash near duplicates by covering locality-sensitive hashing, complete within the radius.

Every bit position gets a vector of radius + 1 bits; for each non-zero vector v there is a table
whose mask holds the positions p with odd <m(p), v>.  Two fingerprints that differ in at most
radius positions span at most radius vectors, so some v is orthogonal to all of them: that
table's mask skips every differing bit, and the two collide there for certain.

Equal fingerprints are folded first.  A bucket of up to ``CELL`` fingerprints is searched in one
task, walking from linked ones to those not yet reached, so a dense family costs about its size.
Larger buckets are searched exactly by half-radius balls: two fingerprints within the radius
share a point at most radius / 2 flips from both, and all that share such a point are within
the radius of each other; each is tied to the smallest, no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import components, give_back, let_go, pick
from benchloom.session import cut

BITS = 64
SHINGLE = 4
RADIUS = 4
CELL = 4096
SEED = 42
BLOCK = 1 << 16
SET_SHINGLE = 5
SKETCH_BITS = 1024  # of a shingle set
BANDS, BAND_ROWS = 32, 5  # sets alike to 0.8 share no band with a chance of 3e-6
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _stirred(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles (the splitmix64 finaliser); k = 0 leaves them as they are."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingled(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by single spaces, and where each shingle starts and stops; a shorter text is one shingle, a wordless one none."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    n = max(1, len(words) - shingle + 1)
    return b" ".join(words), [0, *(ends[: n - 1] + 1).tolist()] if words else [], ends[min(shingle, len(words)) - 1 :].tolist()


def fingerprints(text: str | None, shingle: int = SHINGLE, seed: int = SEED, prints: int = 1) -> list[int]:
    """Bit p is 1 if it is set in over half the shingle hashes; 0 for a text without words.  One for each hash function."""
    joined, starts, stops = _shingled(text, shingle)
    if not (n := len(starts)):
        return [0] * prints
    ones, digest = np.zeros((prints, BITS), np.int64), xxhash.xxh64_intdigest
    for begin in range(0, n, BLOCK):
        spans = zip(starts[begin : begin + BLOCK], stops[begin : begin + BLOCK], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        for k in range(prints):
            ones[k] += np.unpackbits(_stirred(hashes, k).view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return fingerprints(text, shingle, seed)[0]


@cache
def masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks; positions take the non-zero vectors in turn, so masks are about equal in size."""
    vectors = [1 + p % ((1 << (radius + 1)) - 1) for p in range(BITS)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(1 << p for p in range(BITS) if (vectors[p] & v).bit_count() % 2)) for v in range(1, 1 << (radius + 1))]


def flips(upto: int) -> list[int]:
    """All words with at most ``upto`` ones, as signed 64-bit integers."""
    words = [sum(1 << p for p in at) for k in range(upto + 1) for at in combinations(range(BITS), k)]
    return [x - (1 << 64) if x >> 63 else x for x in words]


def fingerprint_column(text: Column, shingle: int = SHINGLE, prints: int = 1) -> Column:
    """The fingerprints of a whole text as array<bigint>; null and wordless texts give 0."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        flat = np.array([fingerprints(t.as_py(), shingle, prints=prints) for t in texts], np.uint64).reshape(-1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * prints), pa.array(flat))

    return run(text.cast("string"))


def _walk(radius: int):
    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def run(lists: pa.Array) -> pa.Array:
        let_go()
        out = []
        for one in lists:
            left = np.unique(np.array(one.values).view(np.uint64))
            edges = []
            while len(left):
                queue, left = [left[0]], left[1:]
                root = queue[0]
                while queue and len(left):
                    near = np.bitwise_count(left ^ queue.pop()) <= radius
                    if near.any():
                        found, left = left[near], left[~near]
                        edges += [{"a": int(x), "b": int(root)} for x in found.view(np.int64)]
                        queue += list(found)
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            out.append([{"a": e["a"], "b": signed(e["b"])} for e in edges])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (k, a, b) that connect exactly what links within the radius connect, from distinct (k, fp); fingerprints of different k never link."""
    if radius % 2:
        raise ValueError("the radius must be even: an odd distance leaves one flip more on one side")
    wide = prints.select("k", "fp", F.explode(F.array(*[F.xxhash64("k", F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("bigint"))) for t, m in enumerate(masks(radius))])).alias("key"))
    wide = wide.repartition("k", "key")  # counted and joined where it lies: the keys, 31 a fingerprint, move once
    counts = wide.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    met = cut(wide.join(counts, ["k", "key"]), "buckets")
    two = met.filter("n = 2 and fp = a").select("k", "a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    more = met.filter("n > 2").select("k", "key", "n", "fp")
    lists = more.filter(F.col("n") <= CELL).groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))
    walked = lists.select("k", F.explode(_walk(radius)(F.col("fps"))).alias("e")).select("k", "e.a", "e.b")
    crowded = more.filter(F.col("n") > CELL).select("k", "fp").distinct()
    points = F.array(*[F.lit(x).cast("bigint") for x in flips(radius // 2)])
    balls = crowded.select("k", "fp", F.explode(points).alias("x")).select("k", "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    least = balls.groupBy("k", "point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("k", "point", "b")
    tied = balls.join(least, ["k", "point"]).select("k", F.col("fp").alias("a"), "b").filter("a <> b")
    return two.unionByName(walked).unionByName(tied).distinct()


def shingle_set(text: str | None, shingle: int = SET_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order; empty for a text without words."""
    joined, starts, stops = _shingled(text, shingle)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64) | np.array([[1], [0]], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One key a band, equal if the least of ``BAND_ROWS`` permutations are the same shingles; none for an empty set."""
    if not len(hashes):
        return []
    times, plus = _multipliers()
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for begin in range(0, len(hashes), 4096):
        mixed = hashes[begin : begin + 4096, None] * times + plus
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).min(0))
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, BAND_ROWS))]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Every shingle of a set flips one bit, so two sketches differ in no more bits than the sets do in shingles."""
    flipped = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flipped.astype(np.uint8), bitorder="little").view(np.int64)


def _sketched(text: Column, shingle: int, prints: int) -> Column:
    """struct<set, n, bits, fps, bands> of a whole text: a hash of its shingle set, its size and sketch, its fingerprints, its band keys."""

    @F.arrow_udf("struct<set:bigint,n:int,bits:array<bigint>,fps:array<bigint>,bands:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        let_go()
        sets, sizes, bits, fps, keys = [], [], [], [], []
        for t in texts:
            t = t.as_py()
            own = shingle_set(t)
            sizes.append(len(own))
            bits.append(sketch(own))
            sets.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
            fps.append(np.array(fingerprints(t, shingle, prints=prints), np.uint64).view(np.int64).tolist())
            keys.append(bands(own))
        many = pa.list_(pa.int64())
        columns = [pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, many), pa.array(fps, many), pa.array(keys, many)]
        out = pa.StructArray.from_arrays(columns, names=["set", "n", "bits", "fps", "bands"])
        del sets, sizes, bits, fps, keys, columns
        give_back()  # the worker idles through the shuffles that follow
        return out

    return run(text.cast("string"))


def _shingles(text: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        let_go()
        return pa.array([shingle_set(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return run(text.cast("string"))


def _may_be_alike(similarity: float) -> Column:
    """False only for pairs (na, bitsa), (nb, bitsb) that cannot reach ``similarity``, by sizes and sketches."""
    apart = sum((F.bit_count(F.col("bitsa")[k].bitwiseXOR(F.col("bitsb")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    apart = F.greatest(apart, F.abs(F.col("na") - F.col("nb")))
    # A thousandth more is let through, so that rounding cannot cost a pair.
    return apart * (1 + similarity) <= (F.col("na") + F.col("nb")) * (1 - similarity) * 1.001


def _partnered(similarity: float):
    """The members of a bucket that may be alike to another one of it, by sizes and sketches."""

    @F.arrow_udf("array<bigint>")
    def run(lists: pa.Array) -> pa.Array:
        let_go()
        out = []
        for one in lists:
            members = one.values
            names, sizes = np.array(members.field("c")), np.array(members.field("n"))
            bits = np.array(members.field("bits").flatten()).view(np.uint64).reshape(len(names), -1)
            found = np.zeros(len(names), bool)
            for k in range(len(names)):
                if not found[k]:
                    apart = np.maximum(np.bitwise_count(bits ^ bits[k]).sum(1, dtype=np.int64), np.abs(sizes - sizes[k]))
                    near = apart * (1 + similarity) <= (sizes + sizes[k]) * (1 - similarity) * 1.001
                    near[k] = False
                    found |= near
                    found[k] = near.any()
            out.append(names[found].tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return run


def _walk_sets(similarity: float):
    """As ``_walk``, over sets: edges that connect what the pairs of a bucket alike to ``similarity`` connect."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def run(lists: pa.Array) -> pa.Array:
        let_go()
        out = []
        for one in lists:
            members = one.values
            names, sets = members.field("c").to_pylist(), members.field("s")
            sizes = np.array([len(x) for x in sets])
            _, flat = np.unique(np.array(sets.flatten()), return_inverse=True)
            at, owner = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(names)), sizes)
            mark, left, edges = np.zeros(len(flat), bool), np.ones(len(names), bool), []
            left_flat, left_owner = flat, owner
            while left.any():
                root = int(np.flatnonzero(left)[0])
                left[root], queue = False, [root]
                while queue and left.any():
                    k = queue.pop()
                    mark[own := flat[at[k] : at[k + 1]]] = True
                    common = np.bincount(left_owner[mark[left_flat]], minlength=len(names))
                    mark[own] = False
                    found = np.flatnonzero(left & (common / (sizes[k] + sizes - common) >= similarity))
                    if len(found):
                        edges += [{"a": names[x], "b": names[root]} for x in found]
                        left[found] = False
                        queue += found.tolist()
                        stay = left[left_owner]
                        left_flat, left_owner = left_flat[stay], left_owner[stay]
            out.append(edges)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return run


def _fingerprint_links(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs of classes (a, b) to look at: each class and the smallest with its fingerprint, and the smallest of fingerprints that link."""
    each = cut(classes.select("class", F.posexplode("fps").alias("k", "fp")), "prints")
    lead = cut(each.groupBy("k", "fp").agg(F.min("class").alias("lead")), "leads")
    found = links(lead.select("k", "fp"), radius)
    of = lambda c: lead.select("k", F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    between = found.join(of("a"), ["k", "a"]).join(of("b"), ["k", "b"]).select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    return between.unionByName(each.join(lead, ["k", "fp"]).select(F.col("class").alias("a"), F.col("lead").alias("b")))


def similar_links(marked: DataFrame, similarity: float, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between classes whose shingle sets are alike to ``similarity``, from (seq, class, n, bits, fps, bands, text).

    Pairs come from fingerprints within the radius and from shared bands; each edge is checked
    by the exact Jaccard of the two sets.  Sizes and sketches first rule out the pairs, and the
    members of buckets, that cannot reach it, so whole sets are made and moved for the others
    only.  A bucket's members are first held against its
    smallest; where one of them fails, the whole bucket is searched.  So the edges connect all
    that pairs alike and sharing a band connect, without listing the pairs of a family.
    """
    classes = cut(marked.groupBy("class").agg(F.min("seq").alias("seq"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("fps").alias("fps"), F.min("bands").alias("bands")), "classes")
    wide = classes.select("class", F.explode("bands").alias("key"))
    buckets = cut(wide.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).filter("n > 1"), "buckets")
    members = cut(wide.join(buckets.filter("n > 2").select("key", F.col("a").alias("least")), "key"), "members")
    stars = members.filter("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    pairs = stars.unionByName(buckets.filter("n = 2").select("a", "b")).unionByName(_fingerprint_links(classes, radius))
    pairs = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    small = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    pairs = cut(pairs.join(small("a"), "a").join(small("b"), "b").select("a", "b", _may_be_alike(similarity).alias("open")), "pairs")
    own = members.join(classes.select("class", "n", "bits"), "class").select("key", F.struct(F.col("class").alias("c"), "n", "bits").alias("m"))
    own = own.groupBy("key").agg(F.collect_list("m").alias("m"))
    partnered = cut(own.select("key", F.explode(_partnered(similarity)(F.col("m"))).alias("class")), "partnered")
    near = pairs.filter("open").select("a", "b")
    wanted = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).unionByName(partnered.select("class")).distinct()
    texts = marked.select("seq", "text").join(classes.join(wanted, "class", "left_semi").select("seq", "class"), "seq")
    sets = cut(texts.select("class", _shingles(F.col("text")).alias("s")), "sets")
    of = lambda c: sets.select(F.col("class").alias(c), F.col("s").alias(f"s{c}"))
    common = F.size(F.array_intersect("sa", "sb"))
    checked = near.join(of("a"), "a").join(of("b"), "b")
    checked = cut(checked.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("alike")), "checked")
    failed = checked.filter(F.col("alike") < similarity).select("a", "b").unionByName(pairs.filter("not open").select("a", "b")).toDF("class", "least")
    unsure = members.join(failed, ["class", "least"], "left_semi").select("key").distinct()
    rest = cut(partnered.join(unsure, "key", "left_semi"), "unsure")
    same = rest.groupBy("key").agg(F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("x"), F.count("*").alias("n"))
    once = same.groupBy("x", "n").agg(F.min("key").alias("key")).select("key")  # equal buckets are searched once
    lists = rest.join(once, "key").join(sets, "class").groupBy("key").agg(F.collect_list(F.struct(F.col("class").alias("c"), "s")).alias("m"))
    walked = lists.select(F.explode(_walk_sets(similarity)(F.col("m"))).alias("e")).select("e.a", "e.b")
    return checked.filter(F.col("alike") >= similarity).select("a", "b").unionByName(walked)


def _groups(marked: DataFrame, radius: int, prints: int) -> DataFrame:
    """(class, group) of the classes that links within the radius connect, from (class, fps)."""
    classes = marked.groupBy("class").agg(F.min("fps").alias("fps"))
    each = classes.select("class", F.posexplode("fps").alias("k", "fp"))
    found = links(each.select("k", "fp").distinct(), radius)
    if prints == 1:  # a class is its fingerprint
        edges = found.select("a", "b")
    else:
        node = lambda c: F.xxhash64("k", F.col(c))
        edges = found.select(node("a").alias("a"), node("b").alias("b")).unionByName(each.select(F.col("class").alias("a"), node("fp").alias("b")))
    return _rooted(classes, edges)


def _rooted(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return classes.join(components(edges), F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, prints: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id reachable by links.

    Fingerprints within ``radius`` bits link.  With several ``prints``, each by another hash
    function, texts link if one pair of theirs does; ``fingerprint`` shows the first.  Null,
    empty and wordless texts share fingerprint 0 and link with each other; rows with a null id
    take part, but never give the component its id unless no row of it has one (then it is
    null).  Repeated rows come out as often as they went in; other columns are ignored; an empty
    table gives no rows.
    """
    rows = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    marked = rows.select("doc_id", fingerprint_column(F.col("text"), shingle, prints).alias("fps"))
    marked = cut(marked.withColumn("class", _class(F.col("fps"), prints)), "prints")
    least = marked.groupBy("class").agg(F.min("doc_id").alias("least"))
    members = cut(_groups(marked, radius, prints).join(least, "class"), "members")
    ids = members.groupBy("group").agg(F.min("least").alias("component_id"))
    named = members.join(ids, "group").select(F.col("class").alias("c"), "component_id")
    out = marked.join(named, F.col("class") == F.col("c"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def _class(fps: Column, prints: int) -> Column:
    return fps[0] if prints == 1 else F.xxhash64(fps)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, prints: int = 1, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns as they were.

    Groups are those of ``near_duplicates``, or with ``similarity`` those that pairs connect
    whose sets of ``SET_SHINGLE``-word shingles are alike to it (``similar_links``).  Of each
    group the row with the smallest id stays, null ids last; of rows with that id, the one whose
    text has the smallest hash.  Rows are numbered as they are written, so equal and null ids
    need not tell them apart.
    """
    rows = docs.withColumn("__seq", F.monotonically_increasing_id())
    if similarity is None:
        rows = rows.withColumn("__s", F.struct(fingerprint_column(F.col(text_col), shingle, prints).alias("fps")))
        rows = cut(rows.withColumn("__class", _class(F.col("__s.fps"), prints)), "numbered")
        groups = _groups(rows.select(F.col("__class").alias("class"), "__s.fps"), radius, prints)
    else:
        rows = rows.withColumn("__s", _sketched(F.col(text_col), shingle, prints))
        rows = cut(rows.withColumn("__class", F.col("__s.set")), "numbered")
        marked = rows.select(F.col("__seq").alias("seq"), F.col("__class").alias("class"), "__s.n", "__s.bits", "__s.fps", "__s.bands", F.col(text_col).alias("text"))
        groups = _rooted(marked.select("class").distinct(), similar_links(marked, similarity, radius))
    own = F.col(id_col).cast("bigint")
    place = F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64(text_col).alias("text"), F.col("__seq").alias("seq"))
    first = rows.groupBy(F.col("__class").alias("class")).agg(F.min(place).alias("first"))
    kept = first.join(groups, "class").groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.seq").alias("__seq"))
    return rows.join(kept, "__seq", "left_semi").select(*docs.columns)
