"""Importance resampling towards a target by hashed n-grams, with n-gram CRCs taken from prefixes.

A document is lower-cased (A-Z), its words are each preceded by one separator, and the result is
scanned once; the running CRC-32 at every word end is kept.  Appending k bytes multiplies a CRC
by x^(8k) over GF(2), so with A the text before an n-gram B, crc(B) = crc(AB) xor x^(8|B|) crc(A):
any n-gram's CRC, of any length, is two kept values and one shift.  Shifts are table look-ups, one
table for each byte of the length, done for all n-grams of a piece at once.

An n-gram's CRC modulo ``buckets`` is its feature.  Spark sums the features of the documents and
of the target; a bucket's gain is the scaled log ratio of its smoothed shares.  A document's
weight is the sum over its features; with Gumbel noise from a hash of its id, the highest scores
are a draw without replacement in proportion to the exponentiated weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import pick
from benchloom.llm.words import slices, starts_of
from benchloom.operators.numbering import rank_in_order
from benchloom.session import cut

BUCKETS = 10_000
LONGEST = 1
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_NORMAL = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_SCANNED = "doc_id bigint, n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"


@cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _times(shift: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """CRCs moved on by the shift with tables ``shift`` (4, 256), one for each of their bytes."""
    return shift[0][crcs & 255] ^ shift[1][(crcs >> 8) & 255] ^ shift[2][(crcs >> 16) & 255] ^ shift[3][crcs >> 24]


@cache
def _shifts(digit: int) -> np.ndarray:
    """(256, 4, 256): the shift by n * 256^digit zero bytes for every n."""
    same = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if digit:
        below = _shifts(digit - 1)
        one = _times(below[255], _times(below[1], same))
    else:
        one = (same >> 8) ^ _crc_table()[same & 255]
    out = [same]
    for _ in range(255):
        out.append(_times(one, out[-1]))
    return np.stack(out)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of zero bytes."""
    out, digit = crcs.astype(np.uint32), 0
    rest = lengths.astype(np.int64)
    while rest.any():
        flat, at = _shifts(digit).reshape(-1), (rest & 255) << 10
        out = flat[at | (out & 255)] ^ flat[at | 256 | ((out >> 8) & 255)] ^ flat[at | 512 | ((out >> 16) & 255)] ^ flat[at | 768 | (out >> 24)]
        rest, digit = rest >> 8, digit + 1
    return out


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text in lower case: runs of digits, letters a to z and characters beyond ASCII."""
    return (text or "").encode("utf-8").translate(_NORMAL).split()


def running_crcs(words: list[bytes]) -> tuple[list[int], list[int]]:
    """The running CRC after each word, from 0 before the first, and the words' lengths."""
    return list(accumulate([b" " + w for w in words], lambda crc, piece: crc32(piece, crc), initial=0)), list(map(len, words))


def feature_crcs(scans: list[tuple[list[int], list[int]]], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, CRC) of all features of several documents, whose scans lie end to end."""
    counts = np.array([len(s[1]) for s in scans], np.int64)
    prefixes = np.concatenate([np.array(s[0], np.uint32) for s in scans]) if scans else np.empty(0, np.uint32)
    lengths = np.concatenate([np.array([*s[1], 0], np.int64) for s in scans]) if scans else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(scans)), counts + 1)  # one place more a document: its last prefix
    left = np.concatenate([np.arange(c, -1, -1) for c in counts]) if scans else np.empty(0, np.int64)  # words from here on
    docs, crcs = [], []
    before = ~prefixes
    before = ~((before >> 8) ^ _crc_table()[(before ^ 0x20) & 255])
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])
    for n in range(1, longest + 1):
        at = np.flatnonzero(left >= n)
        docs.append(owner[at])
        crcs.append(prefixes[at + n] ^ shifted(before[at], ends[at + n] - ends[at] - 1))
    return np.concatenate(docs), np.concatenate(crcs)


def _scanner(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            scans = [running_crcs(normal_words(t.as_py())) for t in piece.column("text")]
            docs, crcs = feature_crcs(scans, longest)
            keys, counts = np.unique(docs * buckets + crcs % buckets, return_counts=True)
            own = keys // buckets
            offsets = pa.array(starts_of(np.bincount(own, minlength=len(scans))), pa.int32())
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    pa.array([len(s[1]) for s in scans], pa.int64()),
                    pa.array(np.bincount(docs, minlength=len(scans)), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys % buckets, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n_words", "n_features", "buckets", "counts"],
            )

    return run


def scan(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts) of every row: its distinct features in ascending order and how often each occurs.

    Features are all runs of 1 to ``longest`` words; null texts have none.  ``id_col=None`` gives null ids.
    """
    rows = docs.select((F.col(id_col) if id_col else F.lit(None)).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scanner(longest, buckets), _SCANNED)


def bucket_totals(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features; every task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            # whole numbers below 2^53 in one batch, so the doubles of bincount are exact
            sums = np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), minlength=buckets)
            total += sums.astype(np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return scanned.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 ln) of the ratio of the smoothed shares in ``target`` and ``raw`` totals."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    both = both.fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + F.lit(float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + F.lit(float(buckets))))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000.0 * F.log(ratio)).cast("bigint").alias("gain"))


def _weigher(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column("buckets"), batch.column("counts").flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            sums = np.zeros(len(lists), np.int64)
            np.add.at(sums, owner, gain[lists.flatten().to_numpy()] * counts)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(scanned: DataFrame, gained: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every scanned row.  The gains, one number a bucket, go through the driver."""
    table = np.zeros(buckets, np.int64)
    for row in gained.collect():  # ``buckets`` rows, whatever the corpus
        table[row.bucket] = row.gain
    return scanned.mapInArrow(_weigher(table), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for rows not drawn.

    Of the N rows with at least ``least_words`` words, floor(``percent`` * N / 100) with the
    highest scores are drawn, ties to the smaller id, null ids last.  Null, empty and wordless
    texts have no features and weight 0.  A null id's noise is that of the text ``null``.
    Repeated rows score alike and are ranked one after another, in no stated order.  Other
    columns are ignored; an empty table gives no rows, an empty target smooths to even shares.
    """
    scanned = cut(scan(docs, id_col, text_col, longest, buckets), "features")
    aims = bucket_totals(scan(pick(target, **{text_col: "string"}), None, text_col, longest, buckets), buckets)
    weighed = weigh(scanned, gains(bucket_totals(scanned, buckets), aims, buckets), buckets)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    enough = F.col("n_words") >= least_words
    rows = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), enough.alias("__fit"), F.monotonically_increasing_id().alias("__seq"))
    order = [F.desc("__fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__seq")]
    # a fit row stands before all others, so its place among the fit ones is its place here
    placed = rank_in_order(rows, order, "rank")
    fit = scanned.agg(F.count(F.when(enough, 1)).alias("n")).select(F.floor(F.col("n") * percent / 100).cast("bigint").alias("__drawn"))
    placed = placed.join(F.broadcast(fit))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("__fit") & (F.col("rank") <= F.col("__drawn")), F.col("rank")).alias("rank"))
