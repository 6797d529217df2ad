"""Failure categories from error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom import fixed
from benchloom.functions.text import col, contains_any


def categorize_failure(message: Column | str, error_type: Column | None = None) -> Column:
    """Category by ordered marker rules; the order is part of the contract."""
    low = F.lower(F.coalesce(col(message), F.lit("")))
    pair = low.contains(fixed.ENV_MARKER_PAIR[0]) & low.contains(fixed.ENV_MARKER_PAIR[1])
    startup = contains_any(low, fixed.STARTUP_MARKERS)
    known = low != ""
    if error_type is not None:
        known = known | F.coalesce(F.btrim(error_type) != "", F.lit(False))
    return (
        F.when(low.contains(fixed.ENV_MARKER) | pair, "env_error")
        .when(startup & contains_any(low, fixed.MODEL_LOAD_MARKERS), "model_load_error")
        .when(startup, "worker_startup_error")
        .when(contains_any(low, fixed.ARTIFACT_MARKERS), "artifact_collection_error")
        .when(known, "task_execution_error")
        .otherwise("unknown_error")
    )
