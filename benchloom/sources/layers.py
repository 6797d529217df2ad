"""Stored layers: readers, partitioned writers, flat CSV, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from benchloom import schemas
from benchloom.functions.text import path_component


def read_layer(spark: SparkSession, root: str, layer: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """One layer of a stored bundle; a missing one is an empty frame of its schema."""
    schema = schema or schemas.LAYERS[layer]
    try:
        return spark.read.schema(schema).format(fmt).load(f"{root}/{layer}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_layers(layers: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """One Parquet dataset per layer; only the partitions present in a frame are replaced."""
    for name, df in layers.items():
        keys = (partition_by or {}).get(name, [])
        out = df.hint("rebalance", *keys) if keys else df
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{name}")


def flat_columns(df: DataFrame) -> DataFrame:
    """Columns by name, nested cells as JSON text, everything else as text, null as empty."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def flat(name: str):
        c = F.col(f"`{name}`")
        if isinstance(kinds[name], nested):
            text = F.to_json(c)
        elif isinstance(kinds[name], T.BooleanType):
            text = F.initcap(c.cast("string"))
        else:
            text = c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return df.select(*[flat(name) for name in sorted(df.columns)])


def write_flat_csv(df: DataFrame, path: str) -> None:
    flat_columns(df).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def write_dataset(df: DataFrame, path: str, by: tuple[str, ...] = ("split", "model_name", "artifact_type")) -> None:
    """Records below ``split=…/model_name=…/artifact_type=…`` with names safe for paths.

    The rebalance hint gathers rows of one directory and, unlike a plain repartition,
    splits a directory that holds a large share of all rows over several files.
    """
    safe = df.withColumns({c: path_component(F.col(c)) for c in by})
    (
        safe.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def read_manifests(spark: SparkSession, root: str, kind: str = "run", file_name: str | None = None) -> DataFrame:
    """All run or experiment manifests below ``root``, newest first; unreadable ones are ignored."""
    name, key = {
        "run": ("run_manifest.json", "run_id"),
        "experiment": ("experiment_manifest.json", "experiment_id"),
    }[kind]
    fields = [
        key, "created_at", "status", "parent_run_id", "source_run_id", "recovery_mode", "execution_mode", "prompt_source",
    ]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in dict.fromkeys(fields)] + [T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(schema).json(
        f"{root}/*/{file_name or name}", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad"
    )
    good = raw.where(F.col("_bad").isNull() & F.col(key).isNotNull()).drop("_bad")
    return good.orderBy(F.desc("created_at"), F.desc(key))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Paths below a folder, read as a distributed listing without file contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path")
