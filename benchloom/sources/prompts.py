"""Prompt readers for text, CSV and JSON-lines files, and the legacy CSV import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom import fixed
from benchloom.functions.text import digits, infer_language, language_alias, normalize_text, strip_ws
from benchloom.operators.numbering import blockwise_row_number
from benchloom.session import cut

_PLACE = ["__file", "__split", "__row"]


def _placed(df: DataFrame) -> DataFrame:
    """Adds the place of each row in its source: file, split start, row within the split.

    Splits are read in order, so the running id orders the rows of a split; only that
    relative order is used, which a re-run reproduces.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__row"),
    )


def _numbered(df: DataFrame, out: str) -> DataFrame:
    """Dense 1-based numbers in file, split, row order; a split is the unit of counting.

    Counting and numbering both need the rows, so they are written once: the source is read
    and its text normalized a single time.
    """
    block = F.struct("__file", "__split")
    return blockwise_row_number(cut(df, "prompts"), keys=[], order=["__row"], block=block, out=out)


def _prompt_id(n: Column | str) -> Column:
    return F.concat(F.lit("prompt_"), digits(F.col(n) if isinstance(n, str) else n, 6))


def read_prompts_text(spark: SparkSession, path: str) -> DataFrame:
    """One prompt per line; blank lines are dropped before numbering."""
    raw = _placed(spark.read.text(path))
    text = raw.select(normalize_text(F.ltrim(F.col("value"), F.lit("﻿"))).alias("prompt"), *_PLACE)
    kept = _numbered(text.where(F.col("prompt") != ""), "seq")
    return kept.select(
        _prompt_id("seq").alias("prompt_id"), "prompt", infer_language("prompt").alias("language"), "seq"
    )


def _json_object(cell: Column) -> Column:
    from benchloom.functions.variants import parse_object

    return F.when(cell == "", F.parse_json(F.lit("{}"))).otherwise(parse_object(cell))


_CSV_COLUMNS = ["prompt_id", "prompt", "language", "negative_prompt", "parameters", "metadata", "version"]


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(
        path, header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", emptyValue="",
    )


def read_prompts_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(prompts, rejected) of a CSV with a ``prompt`` column; the others are optional.

    ``parameters`` and ``metadata`` hold JSON objects; a cell that is none rejects its row.
    Missing ids are numbered among the rows that have a prompt.
    """
    raw = _read_csv(spark, path)
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns if c.startswith("﻿")})
    if "prompt" not in raw.columns:
        raise ValueError("the CSV needs a 'prompt' column")
    own = [c for c in _CSV_COLUMNS if c in raw.columns]
    placed = _placed(raw.select(*own, "_metadata")).select(
        *[normalize_text(F.coalesce(F.col(c) if c in own else F.lit(""), F.lit(""))).alias(c) for c in _CSV_COLUMNS],
        *_PLACE,
    )
    rows = _numbered(placed.where(F.col("prompt") != ""), "seq")
    parsed = rows.select(
        F.coalesce(F.nullif("prompt_id", F.lit("")), _prompt_id("seq")).alias("prompt_id"),
        "prompt",
        F.coalesce(F.nullif(F.lower("language"), F.lit("")), infer_language("prompt")).alias("language"),
        F.nullif("negative_prompt", F.lit("")).alias("negative_prompt"),
        _json_object(F.col("parameters")).alias("parameters"),
        _json_object(F.col("metadata")).alias("metadata"),
        F.nullif("version", F.lit("")).alias("version"),
        "seq",
    )
    bad = F.col("parameters").isNull() | F.col("metadata").isNull()
    return parsed.where(~bad), parsed.where(bad)


def read_prompts_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(prompts, rejected) of a JSON-lines file; bad JSON and a missing id reject the line."""
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("prompt_id", "prompt", "language", "negative_prompt", "version")]
        + [T.StructField(c, T.VariantType()) for c in ("parameters", "metadata")]
        + [T.StructField("_bad", T.StringType())]
    )
    raw = _placed(spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad"))
    text = {
        c: normalize_text(F.coalesce(F.col(c), F.lit("")))
        for c in ("prompt_id", "prompt", "language", "negative_prompt", "version")
    }
    empty = F.parse_json(F.lit("{}"))
    rows = raw.select(
        *[v.alias(c) for c, v in text.items()],
        F.coalesce("parameters", empty).alias("parameters"),
        F.coalesce("metadata", empty).alias("metadata"),
        "_bad",
        *_PLACE,
    )
    parsed = rows.select(
        "prompt_id",
        "prompt",
        F.coalesce(F.nullif(F.lower("language"), F.lit("")), infer_language("prompt")).alias("language"),
        F.nullif("negative_prompt", F.lit("")).alias("negative_prompt"),
        "parameters",
        "metadata",
        F.nullif("version", F.lit("")).alias("version"),
        F.struct(*_PLACE).alias("place"),
        F.when(F.col("_bad").isNotNull(), "bad json").when(F.col("prompt_id") == "", "missing prompt_id").alias("error"),
    )
    return parsed.where(F.col("error").isNull()).drop("error"), parsed.where(F.col("error").isNotNull())


_LEGACY = ["idx", "uuid", "prompt", "keyword", "class_level_0", "class_level_1", "model_type", "lang"]


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the legacy CSV layout with their 1-based row number, blank prompts included."""
    raw = _read_csv(spark, path)
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns if c.startswith("﻿")})
    own = [c for c in _LEGACY if c in raw.columns]
    placed = _placed(raw.select(*own, "_metadata")).select(
        *[F.col(c) if c in own else F.lit("").alias(c) for c in _LEGACY], *_PLACE
    )
    return _numbered(placed, "row_no").drop(*_PLACE)


def import_legacy_prompts(df: DataFrame, category: str, forced_language: str | None = None) -> DataFrame:
    """Legacy rows (with ``row_no``) as prompts with a theme path."""
    t = {c: strip_ws(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in _LEGACY}
    null_if_blank = lambda c: F.nullif(t[c], F.lit(""))
    sub, small = null_if_blank("class_level_1"), null_if_blank("class_level_0")
    theme = F.coalesce(null_if_blank("keyword"), F.substring(t["prompt"], 1, fixed.LEGACY_THEME_CHARS))
    language = language_alias(F.lit(forced_language)) if forced_language else language_alias(t["lang"])
    return df.where(t["prompt"] != "").select(
        F.coalesce(
            null_if_blank("uuid"),
            F.concat(F.lit("legacy_csv_"), null_if_blank("idx")),
            F.concat(F.lit("legacy_prompt_"), digits(F.col("row_no"), 6)),
        ).alias("prompt_id"),
        t["prompt"].alias("prompt"),
        language.alias("language"),
        F.lit(category).alias("category"),
        F.coalesce(sub, F.lit(category)).alias("subcategory"),
        F.coalesce(small, sub, F.lit(category)).alias("subtopic"),
        theme.alias("theme"),
        F.filter(F.array(F.lit(category), sub, small, theme), lambda x: x.isNotNull()).alias("theme_path"),
        null_if_blank("idx").alias("source_idx"),
        null_if_blank("uuid").alias("source_uuid"),
        null_if_blank("model_type").alias("model_type"),
    )
