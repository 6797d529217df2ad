"""Token ids as directly addressable codes: chunk levels, continuation bitmaps, rank directories.

An id is cut into chunks of ``WIDTHS`` bits, low bits first.  Level 0 holds the lowest chunk of
every id; a level's continuation bitmap says which ids go on, and level k+1 holds only those.
The chunk of id i on the next level stands at rank1(bitmap, i), which the rank directory (ones
before every 512-bit block) answers in constant time.  So any token is read by a few array
look-ups; no block is decoded.

A *segment* is one self-contained byte string (format below) of whole documents, about
``SEGMENT_TOKENS`` tokens or one longer document.  Segments are written by Spark into Parquet
rows: its commit protocol makes retried tasks harmless, and any Hadoop file system holds them.

Segment bytes, little endian: ``DAC1``, uint32 documents, uint64 tokens, uint8 levels, then
int64 doc ids, uint8 null flags, uint64 first token of each document, then per level: uint8
width, uint64 chunks, the low-byte plane (widths of 8 or more: one byte a chunk per 8 bits), the
nibble plane (half a byte a chunk where 4 bits are left), and but for the last level the bitmap
and uint32 directory.
"""

from __future__ import annotations

import struct
import zlib
from operator import itemgetter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom.llm.chunks import WordCache
from benchloom.llm.common import held, pick
from benchloom.sizing import broadcast_if_small

WIDTHS = (12, 4, 16)
BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 18
SEGMENTS = "file_no int, segment_no int, before bigint, n_docs bigint, n_tokens bigint, segment binary"
END_ID = 2


def _planes(values: np.ndarray, width: int) -> bytes:
    out = [((values >> shift) & 0xFF).astype(np.uint8).tobytes() for shift in range(0, width - 7, 8)]
    if width % 8:
        nibbles = ((values >> (width - 4)) & 0xF).astype(np.uint8)
        if len(nibbles) % 2:
            nibbles = np.append(nibbles, np.uint8(0))
        out.append((nibbles[0::2] | (nibbles[1::2] << 4)).tobytes())
    return b"".join(out)


class _Level:
    """One level over the segment's bytes; nothing is unpacked until asked for."""

    def __init__(self, data: memoryview, at: int, last: bool):
        self.width, self.n = struct.unpack_from("<BQ", data, at)
        at += 9
        self.bytes = []
        for _ in range(self.width // 8):
            self.bytes.append(np.frombuffer(data, np.uint8, self.n, at))
            at += self.n
        self.nibbles = None
        if self.width % 8:
            self.nibbles = np.frombuffer(data, np.uint8, (self.n + 1) // 2, at)
            at += (self.n + 1) // 2
        self.bitmap = self.directory = None
        if not last:
            size = -(-self.n // BLOCK_BITS) * BLOCK_BITS // 8
            self.bitmap = np.frombuffer(data, np.uint8, size, at)
            self.directory = np.frombuffer(data, np.uint32, size * 8 // BLOCK_BITS, at + size)
            at += size + size * 8 // BLOCK_BITS * 4
        self.end = at

    def chunks(self, where: np.ndarray | slice) -> np.ndarray:
        at = np.arange(self.n)[where] if isinstance(where, slice) and self.nibbles is not None else where
        value: np.ndarray | None = None
        for k, plane in enumerate(self.bytes):
            part = plane[where].astype(np.uint32) << np.uint32(8 * k)
            value = part if value is None else value | part
        if self.nibbles is not None:
            part = (self.nibbles[at >> 1].astype(np.uint32) >> ((at & 1) * 4).astype(np.uint32)) & np.uint32(0xF)
            value = part if value is None else value | (part << np.uint32(8 * len(self.bytes)))
        return value

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, byte = at // BLOCK_BITS, (at % BLOCK_BITS) // 8
        rows = self.bitmap.reshape(-1, BLOCK_BITS // 8)[block]
        before = np.bitwise_count(rows) * (np.arange(BLOCK_BITS // 8) < byte[:, None])
        inside = np.bitwise_count(rows[np.arange(len(at)), byte] & ((1 << (at % 8)) - 1).astype(np.uint8))
        return self.directory[block] + before.sum(1, dtype=np.int64) + inside


class Segment:
    """Random access to a segment's tokens and documents."""

    def __init__(self, data: bytes):
        magic, docs, self.n_tokens, levels = struct.unpack_from("<4sIQB", data, 0)
        if magic != b"DAC1":
            raise ValueError("not a DAC1 segment")
        at = 17
        self.doc_ids = np.frombuffer(data, np.int64, docs, at)
        self.nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.first = np.append(np.frombuffer(data, np.uint64, docs, at + 9 * docs).astype(np.int64), self.n_tokens)
        at += 17 * docs
        self.levels = []
        for k in range(levels):
            self.levels.append(_Level(memoryview(data), at, k == levels - 1))
            at = self.levels[-1].end

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The tokens at any positions of the segment, without decoding their neighbours."""
        positions = np.asarray(positions, np.int64)
        out, on, shift = np.zeros(len(positions), np.uint32), np.arange(len(positions)), 0
        for level in self.levels:
            if not len(on):
                break
            out[on] |= level.chunks(positions) << np.uint32(shift)
            shift += level.width
            if level.bitmap is None:
                break
            more = ((level.bitmap[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1).astype(bool)
            positions, on = level.rank(positions[more]), on[more]
        return out

    def all(self) -> np.ndarray:
        """Every token: the same levels read from end to end."""
        out, on, shift = None, None, 0
        for level in self.levels:
            part = level.chunks(slice(None)) << np.uint32(shift) if level.n else np.zeros(0, np.uint32)
            if out is None:
                out = part
            else:
                out[on] |= part
            shift += level.width
            if level.bitmap is None:
                break
            ones = np.flatnonzero(np.unpackbits(level.bitmap, bitorder="little", count=level.n))
            on = ones if on is None else on[ones]
        return out


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Bytes of a segment: documents with their token counts, all tokens in a row."""
    first = np.cumsum([0, *lengths])[:-1].astype(np.uint64)
    out = [
        np.array([x or 0 for x in doc_ids], np.int64).tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        first.tobytes(),
    ]
    rest, count = ids.astype(np.uint32), 0
    for k, width in enumerate(WIDTHS):
        count += 1
        out.append(struct.pack("<BQ", width, len(rest)))
        out.append(_planes(rest, width))
        if k == len(WIDTHS) - 1:
            break
        rest = rest >> np.uint32(width)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8))
        ones = np.bitwise_count(bits).reshape(-1, BLOCK_BITS // 8).sum(1, dtype=np.int64)
        out += [bits.tobytes(), (np.cumsum(ones) - ones).astype(np.uint32).tobytes()]
        rest = rest[more]
    return struct.pack("<4sIQB", b"DAC1", len(doc_ids), len(ids), count) + b"".join(out)


WORDS_A_TEXT = 128
_START = itemgetter(0)


class Encoder:
    """Texts to bytes of uint32 ids with the tokenizers library.

    With ``special_as_text`` the text of a special token is ordinary text; else it gives the
    token's id, as the library does by default.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def holds_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words that begin with white space; a call gets several words in a row, parted again where their tokens start."""
        for begin in range(0, len(words), 16 * WORDS_A_TEXT):
            groups = [words[k : k + WORDS_A_TEXT] for k in range(begin, min(begin + 16 * WORDS_A_TEXT, len(words)), WORDS_A_TEXT)]
            for group, one in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False), strict=True):
                raw = np.array(one.ids, "<u4").tobytes()
                ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
                # a token's offset may leave out white space before it, never a word's last character
                starts = np.fromiter(map(_START, one.offsets), np.int64, len(raw) // 4)
                cuts = [0, *(4 * np.searchsorted(starts, ends[:-1])).tolist(), len(raw)]
                yield from (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def encoder(path: str, special_as_text: bool = True) -> WordCache:
    def make() -> WordCache:
        own = Encoder(path, special_as_text)
        return WordCache(own.words, own.text, own.holds_added)

    return held(("dac", path, special_as_text), make)


def _packer(path: str, end_id: int, segment_tokens: int, special_as_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, before = encoder(path, special_as_text), 0, 0
        file_no = TaskContext.get().partitionId()
        docs: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        end = struct.pack("<I", end_id)

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            ids = np.frombuffer(b"".join(parts), np.uint32)
            row = [[file_no], [number], [before], [len(docs)], [len(ids)], [pack_segment(docs, lengths, ids)]]
            number, before = number + 1, before + len(ids)
            for x in (docs, lengths, parts):
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["file_no", "segment_no", "before", "n_docs", "n_tokens", "segment"])

        held = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(t.as_py() or "" for t in batch.column(1)), strict=True):
                raw = ids + end
                docs.append(doc_id)
                parts.append(raw)
                lengths.append(len(raw) // 4)
                held += len(raw) // 4
                if held >= segment_tokens:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    return run


def write_segments(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    segment_tokens: int = SEGMENT_TOKENS,
    special_as_text: bool = True,
) -> None:
    """Encodes every whole text, appends ``end_id`` and writes segments in ascending id order.

    Rows are range-partitioned by id (null ids first, equal ids by text); a file holds one range
    and file numbers follow the ranges.  A null text counts as empty and yields the end id
    alone; repeated rows are written as often as they occur; an empty table writes no segment.
    ``special_as_text`` is as in ``Encoder``.
    Other columns of ``docs`` are ignored.
    """
    rows = pick(docs, **{id_col: "bigint", text_col: "string"})
    ranged = rows.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    ranged.mapInArrow(_packer(tokenizer, end_id, segment_tokens, special_as_text), SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the number of tokens before each; the segments themselves are not shuffled.

    A segment knows the tokens before it in its file; only one row per file takes part in the
    running sum.
    """
    rows = spark.read.schema(SEGMENTS).parquet(path)
    files = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))
    return rows.join(broadcast_if_small(files), "file_no").withColumn("start", F.col("file_start") + F.col("before"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = Segment(data.as_py())
            raw = memoryview(own.all().astype("<u4").tobytes())
            bounds = own.first.tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.record_batch(
                [
                    pa.array([None if null else int(i) for i, null in zip(own.doc_ids, own.nulls, strict=True)], pa.int64()),
                    pa.array(own.first[:-1] + start, pa.int64()),
                    pa.array(np.diff(own.first), pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def document_digests(segments: DataFrame) -> DataFrame:
    """Per document as read back: doc_id, start, n_tokens, ids_crc32 over its ids as little-endian uint32."""
    return segments.select("start", "segment").mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _fetcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            at = np.array(wanted.as_py(), np.int64)
            yield pa.record_batch([pa.array(at), pa.array(Segment(data.as_py()).at(at - start), pa.int64())], names=["position", "token"])


def tokens_at(segments: DataFrame, positions: DataFrame, column: str = "position") -> DataFrame:
    """The token at each distinct global position asked for: (position, token); positions outside are left out.

    Positions find their segment by equi-join on blocks of ``SEGMENT_TOKENS`` positions; a
    segment is listed under every block it touches, and only touched segments are opened.
    """
    size = SEGMENT_TOKENS
    spans = segments.select("file_no", "segment_no", F.col("start").alias("s"), (F.col("start") + F.col("n_tokens")).alias("e"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.expr(f"s div {size}"), F.expr(f"(e - 1) div {size}"))))
    asked = positions.select(F.col(column).cast("bigint").alias("p")).filter("p >= 0").distinct().withColumn("block", F.expr(f"p div {size}"))
    hits = asked.join(spans, "block").filter("p >= s and p < e").groupBy("file_no", "segment_no").agg(F.collect_list("p").alias("wanted"))
    found = segments.join(hits, ["file_no", "segment_no"]).select("start", "segment", "wanted")
    return found.mapInArrow(_fetcher, "position bigint, token bigint")
