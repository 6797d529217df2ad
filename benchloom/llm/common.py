"""Shared steps of the training-data operators: typed inputs, shared files, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.session import cut

HELD_OUT_PART = 5
FOREST_EDGES = 500_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: ``pick(df, doc_id="bigint")``; whatever else ``df`` holds cannot clash later."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in columns.items()])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_PART)) == 0, F.lit(False))


_HELD: list[tuple[Any, Any]] = []


def give_back() -> None:
    """Memory that the process has freed goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held(key: Any, make: Callable[[], Any]) -> Any:
    """A worker process's model with its caches, kept from task to task; another key lets the one before go, memory and all."""
    if not _HELD or _HELD[0][0] != key:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD.append((key, make()))
    return _HELD[0][1]


def let_go() -> None:
    """The model that an earlier step held in this worker process goes; for steps without one of their own."""
    held(None, lambda: None)


def _forest(left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    """The edges that a spanning forest of the given ones needs, each node tied to the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(left, right, strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left: list[int] = []
    right: list[int] = []

    def flush() -> pa.RecordBatch:
        a, b = _forest(left, right)
        left.clear()
        right.clear()
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        left += batch.column(0).to_pylist()
        right += batch.column(1).to_pylist()
        if len(left) >= FOREST_EDGES:
            yield flush()
    if left:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b), both bigint; root is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder, until a
    round changes nothing.  Every task first cuts its edges down to a forest.  A node with very
    many edges meets a side with one row per node, which a skew join splits; no row leaves
    Spark but one checksum per round.  Self edges are ignored, an empty table gives no rows.
    """
    plain = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b")
    current = cut(plain.mapInArrow(_local_forest, "a bigint, b bigint"), "edges")
    state = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("v"), "m").distinct()
        roots = large.groupBy(F.col("v").alias("w")).agg(F.min("m").alias("r"))
        small = large.join(roots, F.col("v") == F.col("w")).select("v", "m", "r")
        tied = small.select(F.col("v").alias("a"), F.col("r").alias("b")).unionByName(
            small.filter("m <> r").select(F.col("m").alias("a"), F.col("r").alias("b"))
        )
        current = cut(tied.distinct(), "edges")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
