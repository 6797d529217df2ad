"""Near-duplicate texts by token-set Jaccard >= 0.9, exactly and without quadratic groups.

Two texts are duplicates when their normalized texts are equal or their token sets reach
the threshold.  The work is done on *distinct token sets*: rows that share a normalized
text or a token set are folded first, so a group of copies costs one row however large it
is.  Candidates come from the pigeonhole principle: two sets of at most ``r`` tokens with
Jaccard >= 9/10 differ in at most ``2 r / 19`` tokens.  With the tokens dealt by hash into
one part more than that, some part of both is the same, and its tokens, eight or nine, are
the key to meet by.  Sets of about one size are dealt alike; each takes part in its own size
class and in the next.  Two *different* sets reach 9/10 only with nine common tokens or more.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions.text import by_slices
from benchloom.session import cut

# The threshold as an integer fraction: |a n b| * DEN >= NUM * |a u b|.
NUM, DEN = 9, 10
# Sizes of sets that can be near a different one; the upper bound is beyond any array.
LEAST, MOST = NUM, 1 << 33
# Words of 64 bits in the sketch of a set.
WORDS = 8
# Rows a single (key, salt) cell of the candidate join should hold.
CELL_ROWS = 2_000
MAX_SALTS = 256
# Sets with one anchor from which on they are a group of their own.
POPULAR = 1_000
# Tokens of sets that a Python worker turns into keys or sketches at a time.
SLICE_TOKENS = 1 << 18
# Bits of the map of wanted keys; it has a row for each 64 of them, 2 MB in all, and is broadcast.
MAP_BITS = 1 << 23


def _similarity():
    # Shipped by value, see functions/text.py.  Measured five times faster per text than the
    # equivalent chain of JVM pattern replacement, split, distinct and sort.
    def similarity(texts: list) -> pa.Array:
        other = re.compile("[^a-z0-9\u4e00-\u9fff ]+")
        digests, tokens = [], []
        for s in texts:
            s = "" if s is None else s
            plain = " ".join((s if s.isascii() else unicodedata.normalize("NFKC", s)).split())
            key = other.sub(" ", plain.lower())
            digests.append(hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest())
            tokens.append(sorted(set(key.split())))
        columns = [pa.array(digests, pa.string()), pa.array(tokens, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(columns, names=["text_digest", "tokens"])

    return F.arrow_udf(by_slices(similarity), "struct<text_digest:string,tokens:array<string>>")


def similarity(text: Column | str) -> Column:
    """Struct(text_digest, tokens) of the normalized text.

    Normalized means NFKC, blanks collapsed, lower case, and anything but letters a-z,
    digits, CJK and blanks turned into a blank; tokens are its sorted distinct words.
    """
    return _similarity()(F.col(text) if isinstance(text, str) else text)


@dataclass(frozen=True)
class DuplicateIndex:
    """``members``: seq, text_first, set_first -- the first seq with the same text / token set.
    ``sets``: set_first, tokens -- one row per distinct token set."""

    members: DataFrame
    sets: DataFrame


def duplicate_index(df: DataFrame, text: str = "prompt", seq: str = "seq") -> DuplicateIndex:
    """Folds equal texts and equal token sets, keyed by digests.

    Written once to the shared folder: the texts must not be normalized at every use.  The
    tokens stay there and are not written again for the sets: a row whose set no other row has
    is the first of it, and only the others meet.
    """
    read = df.select(F.col(seq).alias("seq"), similarity(text).alias("s"))
    digested = read.select("seq", F.col("s.text_digest").alias("__text"), F.col("s.tokens").alias("tokens"))
    stored = cut(digested.withColumn("__set", F.sha2(F.concat_ws(" ", "tokens"), 256)), "tokens")
    texts = stored.groupBy("__text").agg(F.min("seq").alias("text_first"))
    firsts = stored.groupBy("__set").agg(F.min("seq").alias("set_first"), F.count("*").alias("c"))
    repeated = cut(firsts.where("c > 1").drop("c"), "repeated-sets")
    own = stored.select("seq", "__text", "__set").join(texts, "__text").join(repeated, "__set", "left")
    members = own.select("seq", "text_first", F.coalesce("set_first", "seq").alias("set_first"))
    rows = _marked(stored.select("seq", "__set", "tokens"), "__set", repeated.select("__set"))
    unlike = rows.where(~F.col("marked")).select(F.col("seq").alias("set_first"), "tokens")
    alike = rows.where("marked").join(repeated, "__set", "left").where(F.col("set_first").isNull() | (F.col("set_first") == F.col("seq")))
    return DuplicateIndex(members, unlike.unionByName(alike.select(F.col("seq").alias("set_first"), "tokens")))


def _marked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` with ``marked``: false only where ``key`` is none of the keys of ``wanted`` (its only column).

    The wanted keys set bits of a map of bounded size, so rows that need not be joined with them
    are told apart where they lie, and are not shuffled.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (spot(c) % 64).cast("int"))
    word = lambda c: F.floor(spot(c) / 64).alias("__word")
    (name,) = wanted.columns
    bits = wanted.groupBy(word(name)).agg(F.bit_or(bit(name)).alias("__bits"))
    met = df.select("*", word(key)).join(F.broadcast(bits), "__word", "left")
    return met.select(*df.columns, (F.coalesce("__bits", F.lit(0)).bitwiseAND(bit(key)) != 0).alias("marked"))


def _bounds() -> list[int]:
    """First sizes of the size classes: no size of a class is over 10/9 of its first one."""
    firsts = [LEAST]
    while firsts[-1] < MOST:
        firsts.append(firsts[-1] * DEN // NUM + 1)
    return firsts


def _parts():
    firsts, limit = np.array(_bounds(), np.int64), SLICE_TOKENS

    def by_tokens(convert):
        def sliced(hashes: pa.Array) -> pa.Array:
            if not len(hashes):
                return convert(hashes)
            ends = np.cumsum(pc.list_value_length(hashes).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = np.unique(ends // limit, return_index=True)[1].tolist()
            return pa.concat_arrays([convert(hashes.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(hashes)], strict=True)])

        return sliced

    def stirred(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(hashes: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        own = np.searchsorted(firsts, sizes, "right") - 1
        keys, widths = [], []
        for step in (0, 1):
            group = own + step
            parts = 2 * (firsts[group + 1] - 1) * (DEN - NUM) // (DEN + NUM) + 1
            at = np.cumsum(parts) - parts
            place = at[owner] + (flat % parts[owner].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(sums, place, stirred(flat))
            which = np.arange(len(sums)) - np.repeat(at, parts)
            label = (np.repeat(group, parts) << 32 | which).astype(np.uint64)
            keys.append(stirred(sums + stirred(label + np.uint64(1))).view(np.int64))
            widths.append(parts)
        offsets = np.concatenate([[0], np.cumsum(widths[0] + widths[1])])
        out = np.empty(int(offsets[-1]), np.int64)
        for step, (key, width) in enumerate(zip(keys, widths, strict=True)):
            begin = offsets[:-1] + (widths[0] if step else 0)
            out[np.arange(len(key)) + np.repeat(begin - (np.cumsum(width) - width), width)] = key
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))

    def sketch(hashes: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bits = np.zeros(len(sizes) * WORDS, np.uint64)
        spot = (stirred(flat) % np.uint64(64 * WORDS)).astype(np.int64)
        np.bitwise_xor.at(bits, owner * WORDS + spot // 64, np.uint64(1) << (spot % 64).astype(np.uint64))
        ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * WORDS)
        return pa.ListArray.from_arrays(ends, pa.array(bits.view(np.int64)))

    return F.arrow_udf(by_tokens(run), "array<bigint>"), F.arrow_udf(by_tokens(sketch), "array<bigint>")


def _keyed(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key): one key for each part of a set, in its own size class and in the next; and (id, n, bits).

    ``bits`` is a sketch of the set: every token flips one bit, so two sketches differ in no
    more bits than the sets do in tokens.  Sets below ``LEAST`` tokens have no keys, since no
    different set is near them.
    """
    n = F.size("tokens")
    keys, sketch = _parts()
    large = sets.where(n >= LEAST)
    hashes = F.transform("tokens", lambda t: F.xxhash64(t))
    return (
        large.select(F.col("set_first").alias("id"), F.explode(keys(hashes)).alias("key")),
        large.select(F.col("set_first").alias("id"), n.alias("n"), sketch(hashes).alias("bits")),
    )


def _shared_keys(sets: DataFrame) -> DataFrame:
    """(id, n, bits, key, head): the keys that several sets have, with the first of these sets.

    Strangers hardly ever share a key, so this is little beside the keys themselves.  Those are
    shuffled once and without the sketches, which join what is shared.
    """
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys, sketches = _keyed(sets)
    dealt = keys.repartition(tasks, "key")
    heads = dealt.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = cut(dealt.join(heads, "key"), "met-keys")
    wanted = _marked(sketches, "id", shared.select("id")).where("marked").drop("marked")
    return cut(shared.join(wanted, "id").select("id", "n", "bits", "key", "head"), "shared-keys")


def _may_be_near(a: str, b: str) -> Column:
    """False only for sets that cannot reach the threshold, by their sizes and sketches."""
    x, y = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}bits")[k].bitwiseXOR(F.col(f"{b}bits")[k])) for k in range(WORDS)), F.lit(0))
    return (F.least(x, y) * DEN >= F.greatest(x, y) * NUM) & (apart * (DEN + NUM) <= (x + y) * (DEN - NUM))


def _candidates(later: DataFrame, every: DataFrame) -> DataFrame:
    """(left, right) ids with left below the bound of right that share a key and may be near.

    ``later``: id, n, bits, key, head, bound, group; ``every``: id, n, bits, key.  An earlier row is only
    taken into a group it can be below a bound of.  The later rows of a hot (key, group)
    are spread over salts and the earlier ones copied to each, so no task holds them all.
    """
    # Rows whose bound is at most the first id of the key have nothing to try there.
    live = later.where(F.col("head") < F.col("bound"))
    sizes = live.groupBy("key", "group").agg(F.max("bound").alias("limit"), F.count("*").alias("c"))
    salts = F.least(F.ceil(F.col("c") / F.lit(CELL_ROWS)), F.lit(MAX_SALTS)).cast("int")
    groups = sizes.select("key", "group", "limit", salts.alias("salts"))
    r = live.join(groups.drop("limit"), ["key", "group"]).select(
        F.col("id").alias("right"), F.col("n").alias("rn"), F.col("bits").alias("rbits"), "key", "group", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "bound"
    )
    l = every.join(groups, "key").where(F.col("id") < F.col("limit")).select(
        F.col("id").alias("left"), F.col("n").alias("ln"), F.col("bits").alias("lbits"), "key", "group", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    joined = l.join(r, ["key", "group", "salt"]).where((F.col("left") < F.col("bound")) & _may_be_near("l", "r"))
    return joined.select("left", "right").distinct()


def _verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates whose token sets reach the threshold, with both set sizes.

    Only the sets that a candidate names are shuffled, but for a few that a bit of theirs lets by.
    """
    candidates = cut(candidates, "candidates")
    named = candidates.select(F.explode(F.array("left", "right")).alias("id"))
    sets = _marked(sets, "set_first", named).where("marked").drop("marked")
    left = sets.select(F.col("set_first").alias("left"), F.col("tokens").alias("lt"))
    right = sets.select(F.col("set_first").alias("right"), F.col("tokens").alias("rt"))
    # The narrow candidate rows meet the possibly hot left ids first; the exchange by right
    # id then spreads the comparison evenly, in as many tasks as asked for.
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    both = candidates.join(left, "left").repartition(tasks, "right").join(right, "right")
    common = F.size(F.array_intersect("lt", "rt"))
    union = F.size("lt") + F.size("rt") - common
    sized = both.select("left", "right", common.alias("common"), union.alias("union_size"))
    return sized.where(F.col("common") * DEN >= F.col("union_size") * NUM)


def near_set_pairs(index: DuplicateIndex) -> DataFrame:
    """Pairs of *different* token sets at or above the threshold, named by their first rows.

    Together with ``members`` this states every near-duplicate pair of rows: two rows are
    near duplicates when their sets are equal or paired.  Rows are never multiplied out.
    """
    keys = _shared_keys(index.sets)
    later = keys.withColumns({"bound": F.col("id"), "group": F.lit(0).cast("bigint")})
    pairs = _verified(_candidates(later, keys), index.sets)
    return pairs.select("left", "right", "common", "union_size", (F.col("common") / F.col("union_size")).alias("jaccard"))


def _set_anchors(index: DuplicateIndex) -> DataFrame:
    """Smallest earlier near set per set, in two exact rounds.

    Round one compares each set with the first sets that hold its keys: linear, and it
    settles nearly all members of a family of near copies.  Round two looks at the other
    earlier sets, but only at those before what round one found.  Sets that share a popular
    anchor form a group of their own there, so a family never meets its own later members.
    """
    keys = _shared_keys(index.sets)
    tried = keys.where(F.col("head") < F.col("id")).select(F.col("head").alias("left"), F.col("id").alias("right")).distinct()
    found = cut(_verified(tried, index.sets).groupBy("right").agg(F.min("left").alias("best")), "anchors")
    popular = found.groupBy("best").agg(F.count("*").alias("members")).where(F.col("members") >= POPULAR).select("best", F.lit(True).alias("popular"))
    settled = found.join(popular, "best", "left").select(F.col("right").alias("id"), "best", F.coalesce("popular", F.lit(False)).alias("popular"))
    group = F.when(F.col("popular"), F.col("best")).when(F.col("best").isNotNull(), F.lit(-1)).otherwise(F.lit(-2)).cast("bigint")
    later = keys.join(settled, "id", "left").select("id", "n", "bits", "key", "head", F.coalesce("best", "id").alias("bound"), group.alias("group"))
    more = _verified(_candidates(later, keys), index.sets).groupBy("right").agg(F.min("left").alias("best"))
    return found.unionByName(more).groupBy("right").agg(F.min("best").alias("anchor"))


def near_duplicates(df: DataFrame, text: str = "prompt", seq: str = "seq") -> DataFrame:
    """One row per text that repeats an earlier one: seq, anchor_seq, kind (``exact`` / ``near``).

    The anchor of an exact repeat is the first row with its normalized text; otherwise it is
    the first earlier row whose token set reaches the threshold.  One row per duplicate:
    the output is linear however large a family of copies is.
    """
    index = duplicate_index(df, text, seq)
    anchors = _set_anchors(index)
    joined = index.members.join(anchors.withColumnRenamed("right", "set_first"), "set_first", "left")
    exact = F.col("text_first") < F.col("seq")
    same_set = F.when(F.col("set_first") < F.col("seq"), F.col("set_first"))
    other = F.when(F.col("anchor") < F.col("seq"), F.col("anchor"))
    near = F.least(same_set, other)
    return joined.select(
        "seq",
        F.when(exact, F.col("text_first")).otherwise(near).alias("anchor_seq"),
        F.when(exact, "exact").otherwise("near").alias("kind"),
    ).where(F.col("anchor_seq").isNotNull())
