"""What the two vector operators share: usable vectors, and groups streamed from sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector with components that are all there and finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def by_length(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, part) of a batch: parts of at most ``rows`` rows whose vectors have one length, so that they are rows of a matrix."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        part = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
        for begin in range(0, part.num_rows, rows):
            yield int(length), part.slice(begin, rows)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def streamed_groups(n_keys: int, work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function over rows sorted by their first ``n_keys`` integer columns: ``work`` gets one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = keys[:, begin].tolist()
                if held and key != last:
                    yield from work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run
