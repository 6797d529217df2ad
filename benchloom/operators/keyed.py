"""Dictionary-overwrite semantics and key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; combines before the shuffle, so a hot key costs one row per task."""
    return _pick(df, keys, order, F.max_by)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key."""
    return _pick(df, keys, order, F.min_by)


def preference() -> Column:
    """Sort key of normalized rows: successful ones first, then the smallest normalizer id."""
    return F.struct((F.lower("status") != "success").alias("failed"), F.col("normalizer_id"))


def preferred_normalized(df: DataFrame) -> DataFrame:
    """The preferred normalized row per request and target."""
    ranked = df.withColumn("__rank", preference())
    return first_wins(ranked, ["request_id", "target_model"], ["__rank"]).drop("__rank")
