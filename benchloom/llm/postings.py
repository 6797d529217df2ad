"""Approximate nearest neighbours by balanced posting lists with replicated boundary vectors.

Building, for each vector length that more than ``CHUNK`` rows have: at most ``SAMPLE`` vectors
(those with the smallest id hash, ``SAMPLE_BYTES`` at most) are drawn.  Three quarters of them
are halved again and again at the median along their widest line, which gives clusters of equal
size; their means are the centroids, ``LIST`` vectors of the table to each and at most
``MOST_LISTS``, so what the driver holds and broadcasts has a fixed bound a length.  A graph joins
each centroid with its nearest ones and a few random ones.  Every vector of the table goes to its
nearest centroid and to others at most ``BOUNDARY`` times as far, ``COPIES`` in all, but not to
one that hardly differs from a centroid chosen before.

Searching: a query walks the graph, in memory, and reads the lists of the centroids at most
``ratio`` times as far as its nearest, of ``BEAM`` at least.  The ratio is measured on the last quarter of the sample,
which shaped no centroid: the least at which ``RECALL`` of true neighbours stand in a list read.
Neighbouring lists form blocks of ``BLOCK_LISTS``; a vector or query comes to a block once, with
its lists there.  A block's rows are spread over chunks of about ``CHUNK``, so a list that a third
of all rows fall in is many tasks' work.  In a chunk a single-precision product finds who can be
among the nearest, and exact products settle them.  Lengths of fewer rows are one list each.

Inner products become distances by one more component, sqrt(max norm^2 - norm^2); for queries it is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom.llm.vectors import by_length, matrix, streamed_groups, usable
from benchloom.session import cut

SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
LIST = 16
MOST_LISTS = 8192
BLOCK_LISTS = 256
NEIGHBOURS = 16
STRANGERS = 4
ENTRIES = 256  # centroids where walks begin
BEAM = 16
COPIES = 3
BOUNDARY = 1.15
APART = 0.3  # of a vector's distance to a centroid: what the centroid must at least differ from those chosen
RECALL = 0.95
PROBES = 512
CHUNK = 4096
BATCH = 512
WALKERS = 64
HELD_ROWS = 1_000_000
PAIRS = 100_000
SEED = 42


@dataclass
class Index:
    centroids: np.ndarray  # single precision
    graph: np.ndarray
    norm2: float  # the largest squared norm of the table
    ratio: float = np.inf
    base: float = 0.0  # a nearest centroid counts as so far at least: the median of vectors that shaped no centroid

    def __post_init__(self):
        self.square = (self.centroids**2).sum(1)
        self.starts = np.unique(np.linspace(0, len(self.centroids) - 1, min(ENTRIES, len(self.centroids))).astype(int))

    def far(self, x: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Distances of the rows of ``x`` from centroids, pair by pair; ``rows`` may be fewer, with a line of centroids each."""
        dots = np.einsum("id,i...d->i...", x[rows], self.centroids[to])
        own = (x[rows] ** 2).sum(1).reshape(-1, *[1] * (to.ndim - 1))
        return np.sqrt(np.maximum(own - 2 * dots + self.square[to], 0.0))

    def limit(self, nearest: np.ndarray) -> np.ndarray:
        return np.maximum(nearest, self.base) * self.ratio + 1e-3 * self.norm2**0.5  # and what single precision may err


def lift(x: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with the component that turns the largest inner product into the least distance."""
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0.0))[:, None]])


def halves(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of ``lists`` clusters whose sizes differ by about one."""
    out, queue = [], [(np.arange(len(x)), lists)]
    while queue:
        at, n = queue.pop()
        if n <= 1 or len(at) <= 1:
            out.append(x[at].mean(0))
            continue
        a, b = x[rng.choice(at)], x[rng.choice(at)]
        for _ in range(4):  # two means, whose line is cut
            near = ((x[at] - a) ** 2).sum(1) <= ((x[at] - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[at[near]].mean(0), x[at[~near]].mean(0)
        order = at[np.argsort(x[at] @ (a - b), kind="stable")]
        left = len(at) * (n // 2) // n
        queue += [(order[:left], n // 2), (order[left:], n - n // 2)]
    return np.array(out)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0.0))


def join_graph(centroids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each centroid's nearest ones and some strangers, which keep the graph in one piece."""
    n, near = len(centroids), min(NEIGHBOURS, len(centroids) - 1)
    if n < 2:
        return np.zeros((n, 1), np.int32)
    rows = []
    for begin in range(0, n, 512):
        d = distances(centroids[begin : begin + 512], centroids)
        d[np.arange(len(d)), np.arange(begin, begin + len(d))] = np.inf
        rows.append(np.argpartition(d, near - 1, axis=1)[:, :near])
    ring = (np.arange(n) + 1) % n
    strangers = [rng.integers(0, n, n) for _ in range(STRANGERS)]
    return np.hstack([np.vstack(rows), *[x[:, None] for x in (ring, *strangers)]]).astype(np.int32)


def nearest(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``BEAM`` nearest centroids (fewer if there are fewer) that a walk of the graph finds, and their distances, nearest first.

    All rows step together: each opens the neighbours of its nearest few centroids not yet
    opened, until its whole beam is.
    """
    first = distances(x, index.centroids[index.starts])
    order = np.argsort(first, axis=1)[:, :BEAM]
    width = min(BEAM, len(index.centroids))
    ids, far = np.full((len(x), width), -1), np.full((len(x), width), np.inf, np.float32)
    ids[:, : order.shape[1]], far[:, : order.shape[1]] = index.starts[order], np.take_along_axis(first, order, 1)
    opened = ids < 0
    rows = np.arange(len(x))
    while len(rows):
        beam = np.argsort(np.where(opened[rows], np.inf, far[rows]), axis=1)[:, :4]
        go = ~np.take_along_axis(opened[rows], beam, 1)
        rows, beam = rows[go.any(1)], beam[go.any(1)]
        if not len(rows):
            break
        opened[rows[:, None], beam] = True
        to = index.graph[np.maximum(ids[rows[:, None], beam], 0)].reshape(len(rows), -1)
        both = np.hstack([ids[rows], to])
        d = np.hstack([far[rows], index.far(x, rows, to)])
        seen = np.hstack([opened[rows], np.zeros(to.shape, bool)])
        place = np.argsort(both * 2 + ~seen, axis=1)  # the same centroid: the opened one first
        both, d, seen = (np.take_along_axis(c, place, 1) for c in (both, d, seen))
        d[:, 1:][both[:, 1:] == both[:, :-1]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids[rows], far[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(d, best, 1)
        opened[rows] = np.take_along_axis(seen, best, 1) | ~np.isfinite(far[rows])
    ids[~np.isfinite(far)] = -1
    return ids, far


def lists_of(index: Index, x: np.ndarray) -> np.ndarray:
    """The lists each vector is written to, a row of ``COPIES``; -1 where it has fewer."""
    ids, far = nearest(index, x)
    chosen, count = np.full((len(x), COPIES), -1), np.ones(len(x), int)
    chosen[:, 0] = ids[:, 0]
    for k in range(1, ids.shape[1]):
        c = ids[:, k]
        fits = (c >= 0) & (count < COPIES) & (far[:, k] <= BOUNDARY * far[:, 0])
        for other in chosen.T:
            fits &= (other < 0) | (((index.centroids[c] - index.centroids[other]) ** 2).sum(1) > (APART * far[:, k]) ** 2)
        at = np.flatnonzero(fits)
        chosen[at, count[at]] = c[at]
        count[at] += 1
    return chosen


def lists_read(index: Index, x: np.ndarray) -> Iterator[np.ndarray]:
    """The lists each query reads: from its nearest centroids on, neighbours are visited as long as they are near enough."""
    n = len(index.centroids)
    for begin in range(0, len(x), WALKERS):
        part = x[begin : begin + WALKERS]
        ids, far = nearest(index, part)
        least, always = far.min(1), np.where(ids >= 0, far, 0.0).max(1)
        known = np.full((len(part), n), np.inf, np.float32)
        r, k = np.nonzero(ids >= 0)
        known[r, ids[r, k]] = far[r, k]
        front = np.flatnonzero(known.ravel() <= np.repeat(np.maximum(index.limit(least), always), n))
        while len(front):
            r, c = front // n, front % n
            met = np.zeros(known.size, bool)
            met[(r[:, None] * n + index.graph[c]).ravel()] = True
            new = np.flatnonzero(met & np.isinf(known.ravel()))
            for s in range(0, len(new), PAIRS):
                at = new[s : s + PAIRS]
                known.ravel()[at] = index.far(part, at // n, at % n)
            np.minimum.at(least, new // n, known.ravel()[new])
            front = new[known.ravel()[new] <= index.limit(least)[new // n]]
        for row, most in zip(known, np.maximum(index.limit(least), always), strict=True):
            yield np.flatnonzero(row <= most)


def build(vectors: DataFrame, n: int, length: int, norm2: float, recall: float = RECALL, top: int = 20, seed: int = SEED) -> Index:
    """The index from (id, v) with ``n`` vectors of one length, given their largest squared norm."""
    most = max(4, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
    drawn = matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow().column("v").combine_chunks())
    rng = np.random.default_rng(seed)
    drawn = drawn[rng.permutation(len(drawn))]
    probes, fit = drawn[: len(drawn) // 4], np.unique(lift(drawn[len(drawn) // 4 :], norm2), axis=0)
    lists = int(min(max(1, n // LIST), MOST_LISTS, max(1, len(fit) // 2)))
    centroids = halves(fit, lists, rng).astype(np.float32)
    index = Index(centroids, join_graph(centroids, rng), norm2)
    placed = np.concatenate([lists_of(index, lift(probes[b : b + BATCH], norm2).astype(np.float32)) for b in range(0, len(probes), BATCH)])
    least, base = [], []
    for k in range(min(PROBES, len(probes))):
        score = probes @ probes[k]
        score[k] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(top, len(probes) - 1)]  # farther than those in the table, so the ratio is on the safe side
        d = distances(np.append(probes[k], 0.0).astype(np.float32)[None], centroids)[0]
        base.append(d.min())
        least += [(base[-1], f) for f in np.where(placed[near] >= 0, d[placed[near]], np.inf).min(1)]
    if least:
        index.base = float(np.median(base))  # vectors of the sample are nearer to the centroids that they shaped
        ratios = [f / max(b, index.base, 1e-12) for b, f in least]
        index.ratio = max(1.0, float(np.quantile(ratios, recall))) * (1 + 1e-5)
    return index


def _nested(own: list[np.ndarray]) -> pa.Array:
    """Each row's lists, ascending, as array<struct<block, lists>>."""
    rows = np.repeat(np.arange(len(own)), [len(o) for o in own])
    lists = np.concatenate(own).astype(np.int32) if len(own) else np.zeros(0, np.int32)
    blocks = lists // BLOCK_LISTS
    first = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (rows[1:] != rows[:-1]))) if len(lists) else np.zeros(0, int)
    inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(lists)).astype(np.int32)), pa.array(lists))
    structs = pa.StructArray.from_arrays([pa.array(blocks[first], pa.int32()), inner], names=["block", "lists"])
    bounds = np.searchsorted(rows[first], np.arange(len(own) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), structs)


def _placer(indexes: dict[int, Index], query: bool):
    """(id, v, places) of (id, v): where a vector is written, or a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in by_length(batch, 1, BATCH):
                index = indexes.get(length)
                if index is None:
                    own = [np.zeros(1, int)] * part.num_rows
                else:
                    x = matrix(part.column(1))
                    if query:
                        own = list(lists_read(index, np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)))
                    else:
                        own = [np.sort(o[o >= 0]) for o in lists_of(index, lift(x, index.norm2).astype(np.float32))]
                yield pa.record_batch([part.column(0), part.column(1), _nested(own)], names=["id", "v", "places"])

    return run


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int, reads: np.ndarray | None = None) -> pa.RecordBatch:
    """(query_id, vec_id, score) of each query's ``top`` among the vectors that it ``reads`` (a boolean row each; all if none are given).

    Ties go to the smaller id.  Scores are sums of products in double precision, alike for equal vectors.
    """
    rough = queries.astype(np.float32) @ x.T.astype(np.float32)
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if reads is not None:
        rough[~reads] = -np.inf
    if rough.shape[1] > top:
        least = np.partition(rough, rough.shape[1] - top, axis=1)[:, rough.shape[1] - top]
    else:
        least = np.full(len(queries), -np.inf, np.float32)
    err = 2e-6 * len(x.T) ** 0.5 * np.sqrt((queries**2).sum(1)) * (np.sqrt((x**2).sum(1).max()) if len(x) else 0.0)
    q, v = np.nonzero((rough >= (least - err)[:, None]) & (rough > -np.inf))
    score = np.concatenate([(x[v[s : s + PAIRS]] * queries[q[s : s + PAIRS]]).sum(1) for s in range(0, len(q), PAIRS)] or [np.zeros(0)])
    return _merged([pa.record_batch([pa.array(query_ids[q], pa.int64()), pa.array(ids[v], pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])], top)


def _reader(top: int):
    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = group.column(3).to_numpy()
        ids, x = group.column(4).to_numpy(), matrix(group.column(5).chunk(0))
        lists = group.column(6).chunk(0)
        data, asked = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        held = np.zeros((len(ids), BLOCK_LISTS), np.float32)
        held[row, lists.flatten().to_numpy() % BLOCK_LISTS] = 1
        for begin in range(0, len(asked), BATCH):
            at = asked[begin : begin + BATCH]
            yield best(ids[at], x[at], ids[data], x[data], top, held[at] @ held[data].T > 0)

    lists = streamed_groups(3, work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's lists are merged query by query before anything is handed on."""
        held, size = [], 0
        for batch in lists(batches):
            held.append(batch)
            size += batch.num_rows
            if size > HELD_ROWS:
                held = [_merged(held, top)]
                size = held[0].num_rows
                if size > HELD_ROWS // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield _merged(held, top)

    return run


def _merged(found: list[pa.RecordBatch], top: int) -> pa.RecordBatch:
    """The ``top`` of each query among rows of several lists, a vector once."""
    q, v, s = (np.concatenate([b.column(k).to_numpy() for b in found]) for k in range(3))
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    once = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])) if len(q) else np.zeros(0, bool)
    q, v, s = q[once], v[once], s[once]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    keep = place < top
    return pa.record_batch([pa.array(q[keep], pa.int64()), pa.array(v[keep], pa.int64()), pa.array(s[keep], pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 20, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest found by inner product, nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's
    own id.  Null, empty or zero vectors, non-finite or null components and null ids take no part;
    a query meets vectors of its own length only.  Rows with one id and equal vectors count once,
    queries that share an id are answered as one.  Other columns are ignored; a table with no
    usable vector gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm2).alias("most")).filter(F.col("n") > CHUNK).collect()
    indexes = {r.d: build(rows.filter(F.size("v") == r.d), r.n, r.d, r.most, recall, top, seed) for r in lengths}
    kinds = "id bigint, v array<double>, places array<struct<block:int,lists:array<int>>>"

    def placed(df: DataFrame, query: bool) -> DataFrame:
        df = df.mapInArrow(_placer(indexes, query), kinds).select("id", "v", F.explode("places").alias("p"))
        return df.select(F.size("v").alias("d"), "p.block", "id", "v", "p.lists")

    data = cut(placed(rows, False), "postings")
    sizes = data.groupBy(F.col("d").alias("sd"), F.col("block").alias("sb")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = F.broadcast(sizes.filter("chunks > 1"))  # blocks of the indexes above, at most MOST_LISTS / BLOCK_LISTS each
    chunks, on = F.coalesce("chunks", F.lit(1)), (F.col("d") == F.col("sd")) & (F.col("block") == F.col("sb"))
    own = F.pmod(F.xxhash64("id"), chunks).cast("int")
    every_one = F.explode(F.sequence(F.lit(0), chunks - 1))
    data = data.join(sizes, on, "left").select("d", "block", own.alias("chunk"), F.lit(0).alias("kind"), "id", "v", "lists")
    asked = placed(rows.filter(F.col("id") % every == 0), True).join(sizes, on, "left")
    asked = asked.select("d", "block", every_one.alias("chunk"), F.lit(1).alias("kind"), "id", "v", "lists")
    met = data.unionByName(asked).repartition("d", "block", "chunk").sortWithinPartitions("d", "block", "chunk")
    found = met.mapInArrow(_reader(top), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
