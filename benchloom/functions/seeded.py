"""Seeded choices that depend on the row only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int | str, *cols: Column | str) -> Column:
    """``md5('seed:a:b')`` as text: a repeatable random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols]))


def draw_index(seed: int | str, size: Column | int, *cols: Column | str) -> Column:
    """Repeatable integer in ``[0, size)`` from the first 32 bits of the draw key."""
    head = F.conv(F.substring(draw_key(seed, *cols), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, (F.lit(size) if isinstance(size, int) else size).cast("bigint"))


def draw_unit(seed: int | str, *cols: Column | str) -> Column:
    """Repeatable double in ``[0, 1)``."""
    head = F.conv(F.substring(draw_key(seed, *cols), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)
