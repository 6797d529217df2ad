"""Validation and selection of prompts and cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom import fixed
from benchloom.functions.groups import group_value
from benchloom.functions.seeded import draw_key
from benchloom.functions.text import blank_to_null
from benchloom.operators.numbering import rank_in_order
from benchloom.session import cut
from benchloom.sizing import broadcast_if_small

INLINE_IDS = 500
CAP_DIGITS = 4  # hexadecimal digits of the draw key that a cap counts by


class SelectionError(ValueError):
    """A selection that cannot be carried out as asked."""


# --- P1 -------------------------------------------------------------------------------
def validate_prompts(
    df: DataFrame, languages: list[str] | None = None, seq: str = "seq", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected); ``rejected`` carries an ``errors`` array.

    Of rows that share an id all but the first are offenders.  The first one comes from a
    pre-aggregated minimum, so a hot id is never gathered in one task.
    """
    first = (
        df.where(blank_to_null("prompt_id").isNotNull())
        .groupBy("prompt_id")
        .agg(F.min(seq).alias("__first"), F.count("*").alias("__n"))
        .where("__n > 1")
        .select(F.col("prompt_id").alias("__id"), "__first")
    )
    joined = df.join(first, F.col("prompt_id") == F.col("__id"), "left").drop("__id")
    checks = [
        F.when(blank_to_null("prompt_id").isNull(), F.lit("missing prompt_id")),
        F.when(F.col(seq) > F.col("__first"), F.lit("duplicate prompt_id")),
        F.when(F.coalesce(F.col("prompt"), F.lit("")) == "", F.lit("empty prompt")),
        F.when(
            ~F.coalesce(F.col("language").isin(languages or fixed.SUPPORTED_LANGUAGES), F.lit(False)),
            F.lit("unsupported language"),
        ),
    ]
    for name in ("parameters", "metadata"):
        if name in df.columns:
            shape = F.schema_of_variant(name).startswith("OBJECT")
            checks.append(F.when(~F.coalesce(shape, F.lit(False)), F.lit(f"{name} must be an object")))
    tagged = joined.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull())).drop("__first")
    ok, rejected = tagged.where(F.size("errors") == 0).drop("errors"), tagged.where(F.size("errors") > 0)
    if strict:
        offender = rejected.select("prompt_id", "errors").limit(1).take(1)
        if offender:
            raise ValueError(f"prompt {offender[0].prompt_id}: {', '.join(offender[0].errors)}")
    return ok, rejected


# --- P7, P8 ---------------------------------------------------------------------------
def accept_types(df: DataFrame, types: list[str], column: str = "artifact_type") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected as compatibility failures); an empty list accepts everything."""
    accepted = F.col(column).isin(types) if types else F.lit(True)
    accepted = F.coalesce(accepted, F.lit(False))
    failure = F.concat(F.lit(f"{column}="), F.coalesce(F.col(column), F.lit("")), F.lit(" is not accepted"))
    rejected = df.where(~accepted).withColumns({"stage": F.lit("compatibility"), "error_message": failure})
    return df.where(accepted), rejected


def exportable(df: DataFrame, models: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``disposition``: ``filtered`` (other model), ``skipped`` (failed, no path, no file), ``exported``.

    ``existing`` lists the paths that exist, one row each.
    """
    model = F.coalesce(F.nullif("model_name", F.lit("")), F.lit("unknown-model"))
    outside = ~model.isin(models) if models else F.lit(False)
    path = blank_to_null("artifact_path")
    unusable = (F.coalesce(F.col("status"), F.lit("")) != "success") | path.isNull()
    if existing is not None:
        known = existing.select(F.col("path").alias("__path")).distinct()
        df = df.join(known, path == F.col("__path"), "left")
        unusable = unusable | F.col("__path").isNull()
    disposition = F.when(outside, "filtered").when(unusable, "skipped").otherwise("exported")
    return df.withColumn("disposition", disposition).drop("__path")


def with_existing_artifacts(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose artifact path is in the listing."""
    return df.join(listing.select(F.col("path").alias("artifact_path")), "artifact_path", "left_semi")


# --- P5 -------------------------------------------------------------------------------
@dataclass(frozen=True)
class Selection:
    """Which cases to keep.  Id lists may be Python lists or one-column DataFrames."""

    seed: int = 42
    group_selector: str | None = None
    sample_size_per_group: int | None = None
    undersized: str = "keep_all_warn"
    include_groups: tuple[str, ...] = ()
    exclude_groups: tuple[str, ...] = ()
    include_ids: object = ()
    exclude_ids: object = ()
    splits: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    max_cases: int | None = None

    def __post_init__(self) -> None:
        for name in ("sample_size_per_group", "max_cases"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise SelectionError(f"{name} must be greater than 0")
        if self.undersized not in ("keep_all_warn", "error", "drop_group"):
            raise SelectionError(f"unknown policy for undersized groups: {self.undersized}")


def _by_ids(df: DataFrame, ids: object, keep: bool) -> DataFrame:
    if isinstance(ids, DataFrame):
        table = ids.select(F.col(ids.columns[0]).alias("case_id")).distinct()
        return df.join(broadcast_if_small(table), "case_id", "left_semi" if keep else "left_anti")
    listed = [str(i) for i in ids if i not in (None, "")]
    if not listed:
        return df
    if len(listed) <= INLINE_IDS:
        hit = F.col("case_id").isin(listed)
        return df.where(hit if keep else ~hit)
    table = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(listed)], "case_id string")
    return df.join(broadcast_if_small(table), "case_id", "left_semi" if keep else "left_anti")


def filter_cases(df: DataFrame, spec: Selection) -> DataFrame:
    """ANDed filters; an empty list means no filter."""
    out = _by_ids(_by_ids(df, spec.include_ids, True), spec.exclude_ids, False)
    if spec.splits:
        out = out.where(F.col("split").isin(list(spec.splits)))
    if spec.tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in spec.tags])))
    if spec.include_groups:
        out = out.where(group_value(spec.group_selector).isin(list(spec.include_groups)))
    if spec.exclude_groups:
        out = out.where(~group_value(spec.group_selector).isin(list(spec.exclude_groups)))
    return out


# --- W1, W2 ---------------------------------------------------------------------------
def sample_per_group(
    df: DataFrame, group: Column, n: int | None, seed: int = 42, undersized: str = "keep_all_warn"
) -> tuple[DataFrame, DataFrame]:
    """(sample, undersized groups with requested and actual count).

    The order inside a group is ``md5(seed:case_id)``, so the draw does not depend on
    partitioning.  A first cut to n rows per group and salt keeps a hot group from reaching
    one task whole; the second cut ranks what is left.
    """
    keyed = df.withColumn("__group", group)
    if n is None:
        empty = keyed.sparkSession.createDataFrame([], "group_key string, requested_count bigint, actual_count bigint")
        return keyed.drop("__group"), empty
    counts = keyed.groupBy("__group").agg(F.count("*").alias("__n"))
    short = counts.where(F.col("__n") < n).select(
        F.col("__group").alias("group_key"), F.lit(n).cast("bigint").alias("requested_count"), F.col("__n").alias("actual_count")
    )
    if undersized == "error":
        offender = short.take(1)
        if offender:
            raise SelectionError(f"group {offender[0].group_key} has {offender[0].actual_count} cases, requested {n}")
    drawn = keyed.withColumns(
        {"__draw": draw_key(seed, "case_id"), "__salt": F.pmod(F.xxhash64("case_id"), F.lit(64))}
    )
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("__draw", "case_id"))
    pre = drawn.withColumn("__rank", rank("__group", "__salt")).where(F.col("__rank") <= n)
    kept = pre.withColumn("__rank", rank("__group")).where(F.col("__rank") <= n)
    if undersized == "drop_group":
        enough = counts.where(F.col("__n") >= n).select("__group")
        kept = kept.join(enough, "__group", "left_semi")
    return kept.drop("__group", "__draw", "__salt", "__rank"), short


def cap_cases(df: DataFrame, max_cases: int | None, seed: int = 42) -> DataFrame:
    """At most ``max_cases`` rows, drawn by hash order, in no order.

    ``df`` is written once.  Counts of the draw keys' leading digits, at most 65,536 of them,
    tell which digits are all in and which are at the edge; only the rows at the edge are put in
    order, in ranges, so no task sees the whole draw.
    """
    if max_cases is None:
        return df
    drawn = df.withColumn("__draw", draw_key(seed, F.lit("cap"), F.col("case_id")))
    drawn = cut(drawn.withColumns({"__lead": F.substring("__draw", 1, CAP_DIGITS), "__seq": F.monotonically_increasing_id()}), "drawn")
    taken, edge, rest = 0, None, 0
    for row in sorted(drawn.groupBy("__lead").count().collect()):
        if taken + row["count"] > max_cases:
            edge, rest = row["__lead"], max_cases - taken
            break
        taken += row["count"]
    else:
        return drawn.select(*df.columns)
    placed = rank_in_order(drawn.where(F.col("__lead") == edge), [F.col("__draw"), F.col("case_id"), F.col("__seq")], "__place")
    return drawn.where(F.col("__lead") < edge).select(*df.columns).unionByName(placed.where(F.col("__place") <= rest).select(*df.columns))


# --- U4, W11 --------------------------------------------------------------------------
def excluded_cases(every: DataFrame, selected: DataFrame) -> DataFrame:
    """Cases that were not selected."""
    return every.join(selected.select("case_id").distinct(), "case_id", "left_anti")


def group_counts(before: DataFrame, after: DataFrame, group: Column) -> DataFrame:
    """Case counts per group before and after a selection."""
    b = before.groupBy(group.alias("group_key")).agg(F.count("*").alias("count_before"))
    a = after.groupBy(group.alias("group_key")).agg(F.count("*").alias("count_after"))
    return b.join(a, "group_key", "full_outer").select(
        "group_key",
        F.coalesce("count_before", F.lit(0)).cast("bigint").alias("count_before"),
        F.coalesce("count_after", F.lit(0)).cast("bigint").alias("count_after"),
    )


@dataclass(frozen=True)
class Sampled:
    selected: DataFrame
    excluded: DataFrame
    counts: DataFrame
    undersized: DataFrame


def sample_bundle(cases: DataFrame, spec: Selection, new_benchmark_id: str | None = None) -> Sampled:
    """Filters, per-group sample and cap in one go, with the complement and the counts; the selection is computed once and written."""
    group = group_value(spec.group_selector)
    filtered = filter_cases(cases, spec)
    sampled, short = sample_per_group(filtered, group, spec.sample_size_per_group, spec.seed, spec.undersized)
    # written once: the selection itself, its counts and its complement all read it
    selected = cut(cap_cases(sampled, spec.max_cases, spec.seed), "selected")
    counts = group_counts(cases, selected, group)
    excluded = excluded_cases(cases, selected)
    if new_benchmark_id:
        selected = selected.withColumn("benchmark_id", F.lit(new_benchmark_id))
    return Sampled(selected, excluded, counts, short)
