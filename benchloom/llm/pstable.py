"""Near duplicates among vectors by Euclidean p-stable hashing, links confirmed by exact cosines.

A hash is floor((a.x + b) / w) of the normalised vector with a Gaussian a; a table's bucket is
given by several of them.  At cosine 0.95 normalised vectors are sqrt(0.1) apart, and the
chance that a hash agrees there (``agree``) gives how many tables keep the chance to miss such a
pair below ``MISS``; closer pairs are missed far less often.  Hashes per table follow the number
of vectors, so that unrelated ones seldom meet, at any size.

Equal vectors are folded first.  Only buckets with company bring their vectors together, in
cells of at most two chunks of ``CHUNK`` vectors.  A pair is counted in the first table where it meets,
which both signatures tell, so no pair is written: a cell gives link counts and a forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import _forest, components
from benchloom.llm.vectors import by_length, matrix, streamed_groups, usable
from benchloom.session import cut

COSINE = 0.95
WIDTH = 2.0
MISS = 1e-3
COMPANY = 0.05  # unrelated vectors a bucket shall hold, on average
CHUNK = 2048
SEED = 42


def agree(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash is the same for two points at a distance (Datar et al.)."""
    r = width / distance
    return 1 - 2 * NormalDist().cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Hashes a table and tables for n vectors."""
    hashes = max(4, math.ceil(math.log(max(n, 2) / COMPANY) / -math.log(agree(math.sqrt(2)))))
    meet = agree(math.sqrt(2 - 2 * cosine)) ** hashes
    return hashes, math.ceil(math.log(miss) / math.log(1 - meet))


def _signer(hashes: int, tables: int, seed: int):
    def hashers(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        lines, offsets = rng.standard_normal((length, hashes * tables)), rng.uniform(0, WIDTH, hashes * tables)
        return lines, offsets, rng.integers(1, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, made = None, None
        for batch in batches:
            for length, part in by_length(batch, 1, 1024):
                if length != have:
                    have, made = length, hashers(length)
                lines, offsets, mix = made
                x = matrix(part.column(1))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cells = np.floor((x @ lines + offsets) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, hashes)
                keys = ((cells * mix).sum(2, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), lists], names=["id", "v", "n", "keys"])

    return run


def _linker(cosine: float):
    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        """Counts (a, null, links) and forest edges (a, b, 0) of one cell: pairs inside its chunk, or across its two."""
        table = group.column(1)[0].as_py()
        same_chunk = group.column(3)[0].as_py() == group.column(4)[0].as_py()
        ids, many = group.column(6).to_numpy(), group.column(8).to_numpy()
        first = group.column(5).to_numpy()
        x = matrix(group.column(7).chunk(0))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys = group.column(9).chunk(0).flatten().to_numpy().reshape(len(ids), -1)[:, :table]
        links, left, right = np.zeros(len(ids), np.int64), [], []
        for begin in range(0, len(ids), 512):
            a, b = np.nonzero(x[begin : begin + 512] @ x.T >= cosine)
            a += begin
            keep = a < b if same_chunk else (first[a] == 0) & (first[b] == 1)
            a, b = a[keep], b[keep]
            for s in range(0, len(a), 100_000):  # bounded, however many pairs link
                p, q = a[s : s + 100_000], b[s : s + 100_000]
                new = ~(keys[p] == keys[q]).any(1) if table else np.ones(len(p), bool)
                p, q = p[new], q[new]
                np.add.at(links, p, many[q])
                np.add.at(links, q, many[p])
                more = _forest(ids[p].tolist(), ids[q].tolist())
                left += more[0]
                right += more[1]
        some = np.flatnonzero(links)
        left, right = _forest(left, right)
        yield pa.record_batch(
            [
                pa.array(np.concatenate([ids[some], np.array(left, np.int64)])),
                pa.array([None] * len(some) + right, pa.int64()),
                pa.array(np.concatenate([links[some], np.zeros(len(left), np.int64)])),
            ],
            names=["a", "b", "links"],
        )

    return streamed_groups(5, work)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    nor do rows with a null id; each is its own component.  Vectors of different lengths never
    link, each length is searched among its own.  Rows with equal vectors link, repeated ids too.  Other columns are ignored; an empty table gives
    no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    classes = cut(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n"), "classes")
    hashes, tables = plan(classes.count(), cosine, miss)
    signed = cut(classes.mapInArrow(_signer(hashes, tables, seed), "id bigint, v array<double>, n bigint, keys array<int>"), "signed")
    places = signed.select("id", F.size("v").alias("d"), F.posexplode("keys").alias("t", "key"))
    company = places.groupBy("d", "t", "key").agg(F.count("*").alias("size")).filter("size > 1")
    met = places.join(company, ["d", "t", "key"])
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # every chunk of a bucket meets itself and every other; nearly all buckets have one chunk
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumns({"c1": F.least("own", "other"), "c2": F.greatest("own", "other"), "first": (F.col("own") > F.col("other")).cast("int")})
    full = met.select("d", "t", "key", "c1", "c2", "first", F.col("id").alias("i")).join(signed, F.col("i") == F.col("id"))
    cell = ("d", "t", "key", "c1", "c2")
    cells = full.select(*cell, "first", "id", "v", "n", "keys").repartition(*cell).sortWithinPartitions(*cell)
    found = cut(cells.mapInArrow(_linker(cosine), "a bigint, b bigint, links bigint"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("ca")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b"))
    named = classes.join(counts, F.col("id") == F.col("ca"), "left").join(roots, F.col("id") == F.col("node"), "left")
    named = named.select(
        F.col("v").alias("cv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")
    )
    fits = F.col("id").isNotNull() & usable(F.col("v"))
    joined = rows.join(named, F.when(fits, F.col("v")) == F.col("cv"), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
