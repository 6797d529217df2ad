"""Dense numbers, batches and shards without a window over a whole table or a hot key.

A *block* is a column that never decreases along the order of a key, for instance a file
split or ``seq div 100000``.  Rows are numbered inside (key, block); only one summary row
per block takes part in the running sum across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom.functions.text import col, digits
from benchloom.session import cut

BLOCK_ROWS = 100_000


def seq_block(seq: Column | str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a unique integer order column: at most ``rows`` rows each."""
    return F.floor(col(seq) / F.lit(rows)).cast("bigint")




def _join_summary(df: DataFrame, summary: DataFrame, names: list[str], bring: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join of rows with their block summary."""
    right = summary.select(*[F.col(n).alias(f"__r_{n}") for n in names], *bring)
    cond = None
    for n in names:
        part = F.col(n).eqNullSafe(F.col(f"__r_{n}"))
        cond = part if cond is None else cond & part
    return df.join(right, cond, how).drop(*[f"__r_{n}" for n in names])


def blockwise_row_number(df: DataFrame, keys: list[str], order: list, block: Column, out: str) -> DataFrame:
    """``row_number`` per ``keys`` along (block, order), 1-based and dense."""
    rows = df.withColumn("__block", block)
    parts = [*keys, "__block"]
    sizes = rows.groupBy(*parts).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = W.partitionBy(*parts).orderBy(*order)
    ranked = rows.withColumn("__rn", F.row_number().over(inside))
    joined = _join_summary(ranked, offsets, parts, ["__off"])
    return joined.withColumn(out, (F.col("__off") + F.col("__rn")).cast("bigint")).drop("__block", "__rn", "__off")


def rank_in_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with each row's place from 1 along ``order`` as ``out``.

    Rows are range-partitioned and written once, a range is numbered in one task, and only its
    size meets those of the others.  ``order`` should tell rows apart, or many equal ones share
    a range.
    """
    stored = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = stored.groupBy("__range").agg(F.count("*").alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order)) + F.col("__off")
    return stored.join(F.broadcast(offsets), F.col("__range") == F.col("__r")).withColumn(out, place.cast("bigint")).drop("__range", "__r", "__off")


def number_records(df: DataFrame, order: list[str], prefix: str = "rec_", width: int = 8, partitions: int | None = None) -> DataFrame:
    """Dense global ids along ``order``; the old ``record_id`` is kept as ``source_record_id``.

    Rows are range-partitioned and written once to the shared folder together with their
    range number, so the counts and the numbering see the very same ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id())
    stored = cut(ranged, "numbering")
    numbered = blockwise_row_number(stored, [], [F.col(c) for c in order], F.col("__range"), "__no")
    renamed = numbered.drop("source_record_id").withColumnRenamed("record_id", "source_record_id") if "record_id" in df.columns else numbered
    return renamed.withColumn("record_id", F.concat(F.lit(prefix), digits(F.col("__no"), width))).drop("__no", "__range")


def content_id(*cols: Column | str, prefix: str = "rec_") -> Column:
    """Id from the row's content, for when dense numbers are not needed: no shuffle at all."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*[col(c) for c in cols])), 256), 1, 32))


def batch_size(max_size: int = 1, preferred: int = 1, limit: int | None = None, supported: bool = True) -> int:
    """Rows per batch: the smallest of the limits, at least one, one when batching is unsupported."""
    if not supported:
        return 1
    size = min(max_size, preferred)
    return max(min(size, limit) if limit is not None else size, 1)


def pack_batches(df: DataFrame, key: str, seq: str, signature: str, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``batch_first`` (row number of the batch's first row) and ``batch_index``.

    A batch is a run of consecutive rows of one key with one signature, at most ``size``
    long.  Rows are shuffled once, to blocks of a key, and numbered there.  A block's summary
    is its row count, its first and last signature and where its last run starts; summaries
    of neighbouring blocks join to one of the same form, so a scan over one row a block gives
    each block the rows, the signature and the open run before it, and the cut points are
    exact.
    """
    # a struct is never null, so null keys and signatures compare and join as values
    rows = df.withColumns({"__k": F.struct(F.col(key).alias("k")), "__block": seq_block(seq, block_rows), "__s": F.struct(F.col(signature).alias("s"))})
    parts = ["__k", "__block"]
    inside = W.partitionBy(*parts).orderBy(seq)
    here = rows.withColumns({"__rn": F.row_number().over(inside), "__prev": F.lag("__s").over(inside)})
    # a block's first row starts a run or not, as the block before tells
    here = here.withColumn("__from", F.max(F.when(F.col("__prev") != F.col("__s"), F.col("__rn"))).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    blocks = here.groupBy(*parts).agg(
        F.count("*").alias("__n"), F.min_by("__s", "__rn").alias("__head"), F.max_by("__s", "__rn").alias("__tail"), F.max("__from").alias("__last")
    )
    carry = W.partitionBy("__k").orderBy("__block")
    prior = carry.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns({"__off": F.coalesce(F.sum("__n").over(prior), F.lit(0)), "__before": F.lag("__tail").over(carry)})
    opens = F.col("__before").isNull() | (F.col("__before") != F.col("__head"))
    last = F.when(F.col("__last").isNotNull(), F.col("__off") + F.col("__last")).when(opens, F.col("__off") + 1)
    blocks = blocks.withColumn("__open", F.when(opens, F.col("__off") + 1).otherwise(F.max(last).over(prior))).select(*parts, "__off", "__open")
    joined = here.join(blocks, parts)
    run = F.coalesce(F.col("__off") + F.col("__from"), F.col("__open"))
    position = F.col("__off") + F.col("__rn") - run
    return (
        joined.withColumn("batch_index", (position % size).cast("bigint"))
        .withColumn("batch_first", (F.col("__off") + F.col("__rn") - position % size).cast("bigint"))
        .select(*df.columns, "batch_index", "batch_first")
    )


def batch_table(packed: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per batch with its dense number per key."""
    batches = packed.groupBy(key, "batch_first").agg(F.count("*").alias("n_rows"))
    return blockwise_row_number(batches, [key], [F.col("batch_first")], seq_block("batch_first", block_rows), "batch_no")


def regroup_by_signature(df: DataFrame, key: str, seq: str, signature: str, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows grouped by signature in first-seen order, then cut into batches of ``size``.

    ``group_first`` orders the signatures of a key, ``group_batch`` the batches of a signature.
    """
    first = df.groupBy(key, signature).agg(F.min(seq).alias("group_first"))
    rows = blockwise_row_number(df, [key, signature], [F.col(seq)], seq_block(seq, block_rows), "__no")
    joined = _join_summary(rows, first, [key, signature], ["group_first"])
    return joined.withColumn("group_batch", F.floor((F.col("__no") - 1) / F.lit(size)).cast("bigint")).drop("__no")


def assign_shards(df: DataFrame, key: str, seq: str, shards: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Task i of a key to shard ``i mod shards``."""
    rows = blockwise_row_number(df, [key], [F.col(seq)], seq_block(seq, block_rows), "__no")
    return rows.withColumn("shard", F.pmod(F.col("__no") - 1, F.lit(shards)).cast("bigint")).drop("__no")
