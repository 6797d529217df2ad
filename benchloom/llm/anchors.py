"""Removal of repeated passages by difference-cover anchors.

A set D is a difference cover modulo v if every residue is a difference of two of its members.
Windows are hashed only where a word's place modulo v lies in D.  For any two places i and j of
equal passages there is a shift below v that takes both into D, so a passage of ``window`` words
that occurs twice holds, at the same distance from either start, an anchor of window - v + 1 words
hashed in both.  Anchors that two documents share are extended to all windows that contain them;
only those windows are compared whole.

Documents are packed to compressed blocks, written once.  Blocks ask for a hash once, however many
of their documents hold it, so a passage that a third of all documents share is one row a block,
never a group of documents.  Requests go to hash buckets as packed keys, and answers come back as
bits in the order of the request, which a block derives anew from its rows.  Anchors are asked
with 40 bits beyond their bucket, whose chance agreements cost a comparison and change nothing;
windows with 96.  ``BLOCK_BYTES`` and ``BUCKET_BYTES`` set what a task holds; more documents
make more blocks and buckets of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.vectors import streamed_groups
from benchloom.llm.words import joined, lists, slices, split, starts_of
from benchloom.session import cut

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
MOST_BUCKETS = 1 << 24
_KEY_BITS = 40
_STEPS = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xC2B2AE3D27D4EB4B))
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Plan:
    """What all tasks must agree on."""

    window: int
    period: int
    cover: tuple[int, ...]
    buckets: int

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def covers(cover: tuple[int, ...], period: int) -> bool:
    """True if every residue modulo ``period`` is a difference of two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bytes, payload): rows (doc_id, text) in blocks of about ``BLOCK_BYTES`` of text, compressed."""
    first = TaskContext.get().partitionId() << 32
    for k, piece in enumerate(slices(batches, "text", BLOCK_BYTES)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(piece)
        size = piece.column("text").nbytes
        yield pa.record_batch([pa.array([first + k], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "payload"])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Block:
    """A block's words and the hashes of its windows."""

    def __init__(self, payload: bytes, plan: Plan):
        rows = pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]
        self.plan, self.doc_id = plan, rows.column("doc_id")
        self.words, self.counts = split(rows.column("text"))
        self.starts = starts_of(self.counts)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.nameless = np.array(self.doc_id.is_null())
        self.ids = self.doc_id.fill_null(0).to_numpy()
        coded = self.words.dictionary_encode()
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist())
        self.codes = coded.indices.to_numpy()
        self.lanes = np.frombuffer(digests, "<u8").reshape(-1, 2)

    def hashes(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the ``n`` words from each place on."""
        out = []
        for lane, step in enumerate(_STEPS):
            values, x = self.lanes[:, lane], np.zeros(len(at), np.uint64)
            for k in range(n):
                x = x * step + values[self.codes[at + k]]
            x = (x ^ (x >> np.uint64(32))) * _MIX
            out.append(x ^ (x >> np.uint64(29)))
        return out[0], out[1]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors of texts that hold a window, and their keys: bucket, then hash bits."""
        place = np.arange(len(self.owner)) - self.starts[self.owner]
        left = self.counts[self.owner] - place
        at = np.flatnonzero(np.isin(place % self.plan.period, self.plan.cover) & (left >= self.plan.anchor) & (self.counts[self.owner] >= self.plan.window))
        a, b = self.hashes(at, self.plan.anchor)
        return at, ((b % np.uint64(self.plan.buckets)) << np.uint64(_KEY_BITS)) | (a >> np.uint64(64 - _KEY_BITS))

    def windows(self, shared: np.ndarray) -> Windows:
        """The windows that contain an anchor at one of the places ``shared``."""
        change = np.zeros(len(self.owner) + 1, np.int64)
        begin = self.starts[self.owner[shared]]
        np.add.at(change, np.maximum(shared - (self.plan.period - 1), begin), 1)
        np.add.at(change, shared + 1, -1)
        fits = self.starts[1:][self.owner] - np.arange(len(self.owner)) >= self.plan.window
        return Windows(self, np.flatnonzero((np.cumsum(change)[:-1] > 0) & fits))


class Windows:
    """Windows of a block in groups of equal ones, by bucket and hash, with the least id of each group."""

    def __init__(self, block: Block, at: np.ndarray):
        self.at, n = at, len(at)
        a, b = block.hashes(at, block.plan.window)
        tail, bucket = b.astype(np.uint32), (b >> np.uint64(32)) % np.uint64(block.plan.buckets)
        order = np.lexsort((tail, a, bucket))
        a, tail, bucket = a[order], tail[order], bucket[order]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (tail[1:] != tail[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        self.group = np.empty(n, np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.a, self.tail, self.bucket = a[first], tail[first], bucket[first].astype(np.int64)
        self.own, self.own_nameless = block.ids[block.owner[at]], block.nameless[block.owner[at]]
        ids = np.where(self.own_nameless, np.iinfo(np.int64).max, self.own)[order]
        self.least = np.minimum.reduceat(ids, first) if n else ids
        self.nameless = np.logical_and.reduceat(self.own_nameless[order], first) if n else np.zeros(0, bool)


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the stretches of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(int(values[x]), x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x]


def _ask_anchors(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_py(), plan)
                at, keys = block.anchors()
                order = np.argsort(keys, kind="stable")
                docs, keys = block.owner[at][order], keys[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
                last = np.concatenate([first[1:], [len(keys)]])[: len(first)] - 1
                again, keys = docs[first] != docs[last], keys[first]
                low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8]
                rows = _runs((keys >> np.uint64(_KEY_BITS)).astype(np.int64))
                yield pa.record_batch(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([name] * len(rows), pa.int64()),
                        pa.array([low[x:y].tobytes() for _, x, y in rows], pa.binary()),
                        pa.array([_bits(again[x:y]) for _, x, y in rows], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "again"],
                )

    return run


def _answers(bucket: int, blocks: list[int], sizes: list[int], flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The flags of all requests of a bucket, those with none set left out."""
    ends = np.cumsum(sizes).tolist()
    rows = [(k, _bits(own)) for k, end, n in zip(blocks, ends, sizes, strict=True) if (own := flags[end - n : end]).any()]
    if rows:
        yield pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["block", "bucket", "flags"],
        )


def _answer_anchors(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """An anchor is shared if two blocks ask for it, or two documents of one block hold it."""
    data = rows.column("keys").to_pylist()
    sizes = [len(x) // (_KEY_BITS // 8) for x in data]
    keys = np.zeros((sum(sizes), 8), np.uint8)
    keys[:, : _KEY_BITS // 8] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, _KEY_BITS // 8)
    again = np.concatenate([_flags(x, n) for x, n in zip(rows.column("again").to_pylist(), sizes, strict=True)])
    _, group, n = np.unique(keys.view("<u8").ravel(), return_inverse=True, return_counts=True)
    shared = (n > 1) | (np.bincount(group, again) > 0)
    yield from _answers(rows.column("bucket")[0].as_py(), rows.column("block").to_pylist(), sizes, shared[group])


def _told(answers: list[dict] | None, keys: np.ndarray) -> np.ndarray:
    """One flag a key, from the answers of the buckets; ``keys`` are the buckets asked, in order."""
    out = np.zeros(len(keys), bool)
    given = {x["bucket"]: x["flags"] for x in answers or ()}
    for bucket, begin, end in _runs(keys):
        if bucket in given:
            out[begin:end] = _flags(given[bucket], end - begin)
    return out


def _candidates(block: Block, answers: list[dict] | None) -> Windows:
    at, keys = block.anchors()
    unique, group = np.unique(keys, return_inverse=True)
    shared = _told(answers, (unique >> np.uint64(_KEY_BITS)).astype(np.int64))
    return block.windows(at[shared[group]])


def _ask_windows(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload, answers in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("anchors"), strict=True):
                asked = _candidates(Block(payload.as_py(), plan), answers.as_py())
                keys = np.empty((len(asked.a), 12), np.uint8)
                keys[:, :8] = asked.a.astype("<u8").view(np.uint8).reshape(-1, 8)
                keys[:, 8:] = asked.tail.astype("<u4").view(np.uint8).reshape(-1, 4)
                named = asked.least[~asked.nameless]
                base = int(named.min()) if len(named) else 0
                # modulo 2^64, so that any two ids have a difference
                off = np.where(asked.nameless, 0, asked.least.astype(np.uint64) - np.int64(base).astype(np.uint64))
                width = next(w for w in (1, 2, 4, 8) if not len(off) or int(off.max()) < 1 << 8 * w)
                packed = off.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                rows = _runs(asked.bucket)
                yield pa.record_batch(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([name] * len(rows), pa.int64()),
                        pa.array([keys[x:y].tobytes() for _, x, y in rows], pa.binary()),
                        pa.array([base] * len(rows), pa.int64()),
                        pa.array([packed[x:y].tobytes() for _, x, y in rows], pa.binary()),
                        pa.array([_bits(asked.nameless[x:y]) if asked.nameless[x:y].any() else b"" for _, x, y in rows], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "base", "least", "nameless"],
                )

    return run


def _answer_windows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """A window is a repeat in a block if another block's least id of it is smaller."""
    data = rows.column("keys").to_pylist()
    sizes = [len(x) // 12 for x in data]
    keys = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 12)
    a, tail = np.ascontiguousarray(keys[:, :8]).view("<u8").ravel(), np.ascontiguousarray(keys[:, 8:]).view("<u4").ravel()
    least, nameless = [], []
    for base, packed, none, n in zip(rows.column("base").to_pylist(), rows.column("least").to_pylist(), rows.column("nameless").to_pylist(), sizes, strict=True):
        off = np.zeros((n, 8), np.uint8)
        off[:, : len(packed) // n] = np.frombuffer(packed, np.uint8).reshape(n, -1)
        least.append((off.view("<u8").ravel() + np.int64(base).astype(np.uint64)).astype(np.int64))
        nameless.append(_flags(none, n) if none else np.zeros(n, bool))
    least, nameless = np.concatenate(least), np.concatenate(nameless)
    order = np.lexsort((tail, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (tail[order][1:] != tail[order][:-1])
    first, group = np.flatnonzero(new), np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    top = np.iinfo(np.int64).max
    best = np.minimum.reduceat(np.where(nameless, top, least)[order], first)[group]
    named = np.logical_or.reduceat(~nameless[order], first)[group]
    yield from _answers(rows.column("bucket")[0].as_py(), rows.column("block").to_pylist(), sizes, named & (nameless | (best < least)))


def _strip(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, anchors, windows in zip(batch.column("payload"), batch.column("anchors"), batch.column("windows"), strict=True):
                block = Block(payload.as_py(), plan)
                found = _candidates(block, anchors.as_py())
                outside = _told(windows.as_py(), found.bucket)[found.group]
                least, named = found.least[found.group], ~found.nameless[found.group]
                bad = found.at[outside | (named & (found.own_nameless | (least < found.own)))]
                change = np.zeros(len(block.owner) + 1, np.int64)
                np.add.at(change, bad, 1)
                np.add.at(change, bad + plan.window, -1)
                gone = np.cumsum(change)[:-1] > 0
                edge = np.concatenate([[True], block.owner[1:] != block.owner[:-1]])[: len(gone)]
                opens = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])[: len(gone)]))
                closes = np.flatnonzero(gone & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([gone[1:], [False]]))[: len(gone)]) + 1
                owner = block.owner[opens]
                yield pa.record_batch(
                    [
                        block.doc_id,
                        pa.array(block.counts),
                        pa.array(np.bincount(block.owner[gone], minlength=len(block.counts))),
                        lists(owner, len(block.counts), ("start", opens - block.starts[owner]), ("stop", closes - block.starts[owner])),
                        joined(block.words, block.starts, ~gone),
                    ],
                    names=["doc_id", "n_words", "n_removed", "removed", "kept"],
                )

    return run


def _exchange(asked: DataFrame, answer, name: str) -> DataFrame:
    """(block, ``name``): all answers to a block's requests, as bits a bucket; at most one entry a bucket."""
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    said = dealt.mapInArrow(streamed_groups(1, answer), "block bigint, bucket bigint, flags binary")
    return said.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias(name))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of every row.

    A word is removed if a window of ``window`` consecutive words covers it whose word sequence
    also stands in a row with a smaller id; windows are those of the input.  ``removed`` holds
    the (start, stop) word numbers taken out, ``kept`` the other words joined by one space.  Null
    ids stand after all others; rows with one id, null ids too, remove nothing from each other.
    Null, empty and wordless texts have no words.  Other columns are ignored; an empty table
    gives no rows.
    """
    if not 0 < period <= window or not covers(cover, period):
        raise ValueError("cover must be a difference cover modulo a period of at most the window")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = cut(rows.mapInArrow(pack, "block bigint, bytes bigint, payload binary"), "blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    plan = Plan(window, period, tuple(cover), min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))))
    asked = blocks.select("block", "payload").mapInArrow(_ask_anchors(plan), "bucket bigint, block bigint, keys binary, again binary")
    anchors = cut(_exchange(asked, _answer_anchors, "anchors"), "anchors")
    again = blocks.select("block", "payload").join(anchors, "block")
    asked = again.mapInArrow(_ask_windows(plan), "bucket bigint, block bigint, keys binary, base bigint, least binary, nameless binary")
    windows = _exchange(asked, _answer_windows, "windows")
    told = blocks.select("block", "payload").join(anchors.join(windows, "block", "left"), "block", "left")
    return told.mapInArrow(_strip(plan), "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept string")
