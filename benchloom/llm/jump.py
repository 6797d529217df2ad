"""Sharding by jump consistent hashing: no ring table, and a shard more moves rows only into itself.

The published generator is used (64-bit linear congruential, multiplier 2862933555777941757), so
other implementations place the same keys alike.  Everything is a DataFrame expression; 64-bit
wrap-around is done on 32-bit halves, since ANSI arithmetic refuses overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom.llm.common import pick

MULTIPLIER = 2862933555777941757
LOW, HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
WORD, HALF = 0xFFFFFFFF, 0xFFFF
FIRST_STEPS = 64
SLOT_BLOCKS = 1024
BROADCAST_BLOCKS = 65_536


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(_long(mask))


def _jump(state: Column) -> Column:
    """The generator's next state and the bucket jumped to."""
    hi, lo, j = state["hi"], state["lo"], state["j"]
    first = _and(lo, HALF) * _long(LOW) + 1
    second = F.shiftright(lo, 16) * _long(LOW)
    low = first + F.shiftleft(_and(second, HALF), 16)
    cross = [(hi, LOW), (lo, HIGH)]
    high = F.shiftright(low, 32) + F.shiftright(second, 16)
    for word, factor in cross:
        high = high + word * _long(factor & HALF) + F.shiftleft(_and(word * _long(factor >> 16), HALF), 16)
    high = _and(high, WORD)
    to = F.floor((j + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))).cast("bigint")
    return F.struct(high.alias("hi"), _and(low, WORD).alias("lo"), j.alias("b"), to.alias("j"))


def jump_bucket(key: Column, buckets: int) -> Column:
    """Bucket 0 to ``buckets`` - 1 of a bigint key; a null key counts as 0.

    A key jumps about ln(buckets) times, each time further; rows that have not passed the end
    after ``FIRST_STEPS`` jumps go on for as many as there can be.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    key = F.coalesce(key.cast("bigint"), _long(0))
    start = F.struct(_and(F.shiftrightunsigned(key, 32), WORD).alias("hi"), _and(key, WORD).alias("lo"), _long(-1).alias("b"), _long(0).alias("j"))
    step = lambda state, _: F.when(state["j"] < buckets, _jump(state)).otherwise(state)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(buckets, FIRST_STEPS))), start, step)
    if buckets <= FIRST_STEPS:
        return state["b"].cast("int")
    rest = lambda s: F.when(s["j"] < buckets, F.aggregate(F.sequence(F.lit(1), F.lit(buckets)), s, step)).otherwise(s)
    return F.transform(F.array(state), rest)[0]["b"].cast("int")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``key``.

    ``slot`` numbers the rows of a shard from 0 without gaps: by a hash block of the id, then by
    id and text checksum.  Rows are numbered inside a block; one summary row per shard and block
    takes part in the running sum.  A null text has size 1 and checksum 0, a null id is key 0;
    repeated rows get slots of their own; other columns are ignored; an empty table gives no rows.
    """
    rows = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BLOCKS)).cast("int")
    placed = rows.select(
        "doc_id", (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
        jump_bucket(F.col("doc_id"), shards).alias("shard"), jump_bucket(F.col("doc_id"), shards + 1).alias("grown_shard"),
        block.alias("block"),
    )
    sizes = rows.select(jump_bucket(F.col("doc_id"), shards).alias("shard"), block.alias("block")).groupBy("shard", "block").count()
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    if shards * SLOT_BLOCKS <= BROADCAST_BLOCKS:  # its greatest size is known beforehand
        offsets = F.broadcast(offsets)
    inside = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("n", F.row_number().over(inside)).join(offsets, ["shard", "block"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", files: int = 8) -> None:
    """All columns of ``docs`` as Parquet below ``path``/shard=N, each shard dealt over ``files`` tasks."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(files))
    docs.withColumn(name, jump_bucket(F.col(id_col), shards)).repartition(shards * files, F.col(name), part).write.partitionBy(name).parquet(path)
