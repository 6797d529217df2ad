"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 50_000


def fits(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after the row count has been checked.

    Beyond the bound the frame is returned without a hint, so the join becomes a
    shuffled one that AQE may still split on skew.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def spread_scan(scan: DataFrame) -> DataFrame:
    """A plain file scan in at least as many partitions as there are cores.

    Only for scans that come as fewer splits than cores (a small table in one row group):
    costly per-row work would otherwise run in one task.  A scan with enough splits, any
    large table, is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
