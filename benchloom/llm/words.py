"""Whole texts as Arrow words: runs of characters other than space, tab, line feed, vertical tab, form feed and return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces with about ``size`` bytes in ``column``; a longer text is a piece of its own."""
    for batch in batches:
        bytes_of = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(bytes_of + 1) - 1) // size
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of words of each text); a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    each = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(each)), each)
    return flat.filter(pa.array(real)), np.bincount(owner[real], minlength=len(each)).astype(np.int64)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each text's words start, and where the last one's stop."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def joined(words: pa.Array, starts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep)).cast(pa.string()))
    return pc.binary_join(lists, " ")


def lists(owner: np.ndarray, rows: int, *fields: tuple[str, np.ndarray]) -> pa.Array:
    """Lists of structs of bigint, one list a row, from values in ascending order of ``owner``."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for _, v in fields], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
