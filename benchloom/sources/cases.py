"""Benchmark case reader and the defaults of a case row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.functions import variants as V
from benchloom.functions.text import blank_to_null, first_truthy, strip_ws

_TEXT = [
    "benchmark_id", "case_id", "prompt_id", "input_modality", "input_type", "prompt", "instruction", "context",
    "language", "split", "case_version", "version", "source_builder", "expected_output_contract", "expected_structure",
]
_OBJECTS = ["input_payload", "metadata", "execution_hints", "evaluation_hints", "parameters"]
CASE_FILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.VariantType()) for c in _OBJECTS]
    + [
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("grouping", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_bad", T.StringType()),
    ]
)


def read_cases(
    spark: SparkSession, path: str, benchmark_id: str | None = None, builder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected) of a JSON-lines case file; rows without id or input are rejected."""
    raw = spark.read.schema(CASE_FILE).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    named = raw.select(
        first_truthy("benchmark_id", F.lit(benchmark_id or "")).alias("benchmark_id"),
        first_truthy("case_id", "prompt_id").alias("case_id"),
        blank_to_null(first_truthy("case_version", "version")).alias("case_version"),
        first_truthy("input_modality", "input_type", F.lit("text")).alias("input_modality"),
        "input_payload",
        "metadata",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("split", F.lit("default")).alias("split"),
        first_truthy(blank_to_null("source_builder"), F.lit(builder or "")).alias("source_builder"),
        F.coalesce("grouping", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("grouping"),
        "execution_hints",
        "evaluation_hints",
        F.coalesce("language", F.lit("en")).alias("language"),
        "parameters",
        blank_to_null("prompt").alias("prompt"),
        blank_to_null("instruction").alias("instruction"),
        F.nullif("context", F.lit("")).alias("context"),
        "expected_output_contract",
        "expected_structure",
        "_bad",
    )
    cases = default_case_fields(named)
    error = (
        F.when(F.col("_bad").isNotNull(), "bad json")
        .when(F.col("case_id").isNull(), "missing case_id")
        .when(F.col("rendered_input") == "", "missing input")
    )
    tagged = cases.withColumn("error", error)
    return (
        tagged.where(F.col("error").isNull()).drop("error", "_bad"),
        tagged.where(F.col("error").isNotNull()),
    )


def default_case_fields(df: DataFrame) -> DataFrame:
    """Back-fills prompt, instruction and context from the payload and the other way round.

    Also pairs the two contract columns and adds ``rendered_input``, the first non-empty of
    prompt, instruction and the payload's prompt, instruction, text, input.
    """
    built = F.to_json(F.struct("prompt", "instruction", "context", F.col("language")))
    has_payload = V.kind(F.col("input_payload")).startswith("OBJECT") & (F.to_json("input_payload") != "{}")
    payload = F.when(F.coalesce(has_payload, F.lit(False)), F.col("input_payload")).otherwise(F.parse_json(built))
    contract = F.nullif("expected_output_contract", F.lit(""))
    structure = F.nullif("expected_structure", F.lit(""))
    # One read of the payload per row; the later columns only look at its fields.
    keys = ("prompt", "instruction", "context", "text", "input")
    schema = ", ".join(f"{k} string" for k in keys)
    staged = df.withColumn("input_payload", payload).withColumn("__p", F.from_json(F.to_json("input_payload"), schema))
    filled = staged.withColumns(
        {
            "prompt": first_truthy("prompt", "__p.prompt"),
            "instruction": first_truthy("instruction", "__p.instruction"),
            "context": first_truthy("context", "__p.context"),
            "expected_output_contract": F.coalesce(contract, structure),
            "expected_structure": F.coalesce(structure, contract),
        }
    )
    rendered = first_truthy("prompt", "instruction", "__p.text", "__p.input", F.lit(""))
    return filled.withColumn("rendered_input", strip_ws(F.coalesce(rendered, F.lit("")))).drop("__p")
