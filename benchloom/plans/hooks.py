"""User extension points: normalizers, scorers, group analyzers, plugins, case builders."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from benchloom.session import cut
from benchloom.sources.cases import CASE_FILE, default_case_fields

RowFunction = Callable[[dict], dict | list[dict] | None]


@dataclass
class Hooks:
    """Registered user functions by id."""

    normalizers: dict[str, tuple[object, T.StructType | None]] = field(default_factory=dict)
    scorers: dict[str, tuple[object, T.StructType | None]] = field(default_factory=dict)
    analyzers: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=dict)
    plugins: dict[str, tuple[Callable, tuple[str, ...]]] = field(default_factory=dict)
    builders: dict[str, Callable] = field(default_factory=dict)

    # --- X1, X2 ---
    def register_normalizer(self, name: str, fn, schema: str | T.StructType | None = None) -> None:
        """``fn``: DataFrame -> DataFrame, or with a schema a row function (dict in, dict(s) out)."""
        self.normalizers[name] = (fn, _schema(schema))

    def register_scorer(self, name: str, fn, schema: str | T.StructType | None = None) -> None:
        self.scorers[name] = (fn, _schema(schema))

    def normalize(self, name: str, results: DataFrame) -> tuple[DataFrame, DataFrame]:
        return _run(name, "normalization", "normalizer_id", *self.normalizers[name], results)

    def score(self, name: str, results: DataFrame) -> tuple[DataFrame, DataFrame]:
        return _run(name, "scoring", "scorer_id", *self.scorers[name], results)

    # --- X3 ---
    def register_analyzer(self, name: str, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.analyzers[name] = fn

    def analyze(self, name: str, results: DataFrame, scores: DataFrame) -> DataFrame:
        return self.analyzers[name](results, scores).withColumn("analyzer_id", F.lit(name))

    # --- X4 ---
    def register_plugin(self, name: str, fn: Callable[[dict[str, DataFrame], dict[str, DataFrame]], DataFrame], needs: tuple[str, ...] = ()) -> None:
        """``fn(layers, earlier outputs)``; runs after the plugins it needs."""
        self.plugins[name] = (fn, tuple(needs))

    def run_plugins(self, layers: dict[str, DataFrame], names: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """(outputs, errors by plugin).  A plugin that fails, or whose need failed, stops nothing else.

        Each output is written to the shared folder at once, so that it fails here and not later.
        """
        wanted = list(self.plugins) if names is None else names
        outputs: dict[str, DataFrame] = {}
        errors: dict[str, str] = {}
        for name in plugin_order({n: self.plugins[n][1] for n in wanted}):
            fn, needs = self.plugins[name]
            lacking = [n for n in needs if n in errors]
            if lacking:
                errors[name] = f"needs failed plugin: {', '.join(lacking)}"
                continue
            try:
                outputs[name] = cut(fn(layers, outputs).withColumn("plugin_id", F.lit(name)), f"plugin-{name}")
            except Exception as exc:  # noqa: BLE001 - isolation is the feature
                errors[name] = str(exc)
        return outputs, errors

    # --- X5 ---
    def register_builder(self, name: str, fn: Callable[[SparkSession, dict, int], DataFrame]) -> None:
        """``fn(spark, config, seed)`` returns case rows; missing columns are filled."""
        self.builders[name] = fn

    def build(self, spark: SparkSession, name: str, config: dict | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
        """(cases with defaults, rejected rows without id or input)."""
        rows = self.builders[name](spark, dict(config or {}), seed)
        for f in CASE_FILE.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        filled = rows.withColumns(
            {
                "source_builder": F.coalesce("source_builder", F.lit(name)),
                "input_modality": F.coalesce("input_modality", "input_type", F.lit("text")),
                "split": F.coalesce("split", F.lit("default")),
                "language": F.coalesce("language", F.lit("en")),
            }
        ).drop("_bad")
        cases = default_case_fields(filled)
        ok = (F.coalesce("case_id", F.lit("")) != "") & (F.col("rendered_input") != "")
        return cases.where(ok), cases.where(~ok)


def plugin_order(needs: dict[str, tuple[str, ...]]) -> list[str]:
    """Names so that each follows what it needs; a cycle or an unknown need is an error."""
    from graphlib import CycleError, TopologicalSorter

    unknown = {n for deps in needs.values() for n in deps} - set(needs)
    if unknown:
        raise ValueError(f"unknown plugins: {sorted(unknown)}")
    try:
        return list(TopologicalSorter(needs).static_order())
    except CycleError as exc:
        raise ValueError("plugins need each other") from exc


def _schema(schema: str | T.StructType | None) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _run(name: str, stage: str, id_column: str, fn, schema: T.StructType | None, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    if schema is None:
        return fn(results).withColumn(id_column, F.lit(name)), results.limit(0).select(
            F.lit(stage).alias("stage"), F.lit(name).alias(id_column), F.lit("").alias("error")
        )
    both = map_rows(results, fn, schema)
    good = both.where(F.col("__error").isNull()).drop("__error", "__key").withColumn(id_column, F.lit(name))
    bad = both.where(F.col("__error").isNotNull()).select(
        F.lit(stage).alias("stage"), F.lit(name).alias(id_column), F.col("__key").alias("source_record_id"), F.col("__error").alias("error")
    )
    return good, bad


def map_rows(df: DataFrame, fn: RowFunction, schema: T.StructType, key: str = "source_record_id") -> DataFrame:
    """A user row function over Arrow batches; an exception becomes an error row, never a failed task."""
    names = schema.fieldNames()
    out = T.StructType([*schema.fields, T.StructField("__key", T.StringType()), T.StructField("__error", T.StringType())])

    kinds = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record in batch.to_pylist():
                where = None if record.get(key) is None else str(record.get(key))
                try:
                    made = fn(record)
                    made = [] if made is None else made if isinstance(made, list) else [made]
                    for m in made:  # a value of another type than declared is the row's own error
                        for n in names:
                            pa.array([m.get(n)], kinds.field(n).type)
                    rows += [{**{n: m.get(n) for n in names}, "__key": where, "__error": None} for m in made]
                except Exception as exc:  # noqa: BLE001 - reported as a row
                    rows.append({**dict.fromkeys(names), "__key": where, "__error": str(exc) or type(exc).__name__})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return df.mapInArrow(run, out)


def column_normalizer(**columns: Column) -> Callable[[DataFrame], DataFrame]:
    """A normalizer made of Column expressions only; it stays inside the JVM."""
    return lambda df: df.select("*", *[c.alias(n) for n, c in columns.items()])
