"""Streams folded into mergeable partial results, one folder per micro-batch.

A fold whose result can be merged (max, sum, min) needs no state store: every batch writes
its partial result under its batch id, a replayed batch overwrites its own folder, and a
reader merges what is there.  Late rows are simply merged when they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

Fold = Callable[[DataFrame], DataFrame]


def start(writer, checkpoint: str, available_now: bool = False, interval: str | None = None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_deltas(stream: DataFrame, fold: Fold, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes ``fold(batch)`` per micro-batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(fold(batch), path, batch_id)

    return start(stream.writeStream.foreachBatch(sink), checkpoint, **trigger)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Everything written so far, with the ``batch`` id."""
    return spark.read.parquet(path)


def read_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One folder, or an empty frame of the schema when it is not there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, target: str, merge: Fold) -> None:
    """Writes the merged deltas as one table, for when many small batches have piled up."""
    merge(read_deltas(spark, path)).write.mode("overwrite").parquet(target)
