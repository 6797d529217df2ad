"""Quota planning over a theme tree, draws, and draft prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom import fixed
from benchloom.functions.seeded import draw_index
from benchloom.functions.text import digits, normalize_text
from benchloom.operators.duplicates import near_duplicates
from benchloom.operators.numbering import blockwise_row_number
from benchloom.session import cut
from benchloom.sizing import broadcast_if_small

DRAW_CHUNK = 10_000
# Rows regenerated in a round up to which they are broadcast: a number and a pass each.
BROADCAST_REPEATS = 1_000_000


def path_text(path: Column | str) -> Column:
    """A path as one text; a slash or backslash inside a name gets a backslash, so that paths stay apart."""
    col = F.col(path) if isinstance(path, str) else path
    return F.concat_ws("/", F.transform(col, lambda x: F.regexp_replace(x, r"([\\/])", r"\\$1")))


def level_defaults(defaults: dict[str, int] | None) -> dict[str, int]:
    """Level defaults under the plain level names; the plural and ``per_`` spellings mean the same level."""
    out, unknown = {}, []
    for key, value in (defaults or {}).items():
        name = fixed.THEME_LEVEL_SPELLINGS.get(str(key).strip().lower())
        if name is None:
            unknown.append(key)
        else:
            out[name] = int(value)
    if unknown:
        raise ValueError(f"unknown theme levels: {sorted(map(str, unknown))}")
    return out


def _counted(nodes: DataFrame, counts: dict[str, int] | DataFrame | None, defaults: dict[str, int] | None) -> DataFrame:
    """Nodes with ``quota``: path override, else inline count, else the default of the level."""
    named = level_defaults(defaults)
    depth = F.size("path")
    level = F.lit(None).cast("bigint")
    for i, name in enumerate(fixed.THEME_LEVELS, start=1):
        if name in named:
            level = F.when(depth == i, F.lit(named[name]).cast("bigint")).otherwise(level)
    base = nodes.select(path_text("path").alias("node"), "path", "ord", F.col("count").cast("bigint").alias("inline"), depth.alias("depth"))
    if counts is None or (isinstance(counts, dict) and not counts):
        override = base.withColumn("override", F.lit(None).cast("bigint"))
    else:
        table = counts
        if isinstance(counts, dict):
            table = nodes.sparkSession.createDataFrame([(k, int(v)) for k, v in counts.items()], "node string, override bigint")
        override = base.join(table.select("node", F.col("override").cast("bigint")), "node", "left")
    return override.withColumn("quota", F.coalesce("override", "inline", level)).drop("override", "inline")


def _place(ord_: str = "ord", path: str = "path") -> Column:
    """The order of the tree's nodes, names breaking ties; a node comes right after its last descendant."""
    steps = F.zip_with(ord_, path, lambda o, n: F.struct(o.cast("bigint").alias("o"), n.alias("n")))
    return F.concat(steps, F.array(F.struct(F.lit(9223372036854775807).cast("bigint").alias("o"), F.lit("").alias("n"))))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes in tree order, as far as one range of the order tells them.

    A node whose descendants all stand in the range gets ``taken``.  Ancestors of the range's
    first node may have descendants before it: they come out with ``open``, and what the range
    adds to them, or to nodes after it, as rows without a node.  Those are few: one a level.
    """
    block = TaskContext.get().partitionId()
    first: tuple[str, ...] | None = None
    pending: dict[tuple[str, ...], int] = {}
    at = 0
    for batch in batches:
        out: list[tuple] = []
        for path, quota in zip(batch.column("path").to_pylist(), batch.column("quota").to_pylist(), strict=True):
            path = tuple(path)
            first = path if first is None else first
            taken = pending.pop(path, 0)
            if first[: len(path)] == path:
                out.append((block, at, list(path), True, quota, taken))
            else:
                out.append((block, at, list(path), False, quota, taken))
                up = path[:-1]
                pending[up] = pending.get(up, 0) + max(quota or 0, taken)
            at += 1
        yield _settled(out)
    if pending:
        yield _settled([(block, at + k, list(up), None, None, total) for k, (up, total) in enumerate(sorted(pending.items())) if up])


_SETTLED = "block int, at bigint, path array<string>, open boolean, quota bigint, taken bigint"


def _settled(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "at", "path", "open", "quota", "taken"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``taken`` of the open nodes, from what the ranges leave open, in tree order."""
    pending: dict[tuple[str, ...], int] = {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            path = tuple(row["path"])
            if row["open"]:
                taken = pending.pop(path, 0) + row["taken"]
                out.append((row["block"], row["at"], row["path"], True, row["quota"], taken))
                path, total = path[:-1], max(row["quota"] or 0, taken)
            else:
                total = row["taken"]
            pending[path] = pending.get(path, 0) + total
        yield _settled(out)


def theme_quota_plan(nodes: DataFrame, counts: dict[str, int] | DataFrame | None = None, defaults: dict[str, int] | None = None) -> DataFrame:
    """Allocations: one row per node that keeps a residual quota for itself.

    ``nodes``: path (array), ord (sibling positions, array), count, tags, metadata (map) and, if
    there, constraints (map).  A parent keeps what its descendants did not take.  Level defaults
    name the first four levels.

    In tree order, children before their parent, a subtree is one interval.  Ranges of that
    order are settled each by itself; only the ancestors of a range's first node, one a level,
    need what the ranges before it left, and one pass over those rows closes them.  So the plan
    is the same for every depth of the tree.
    """
    counted = _counted(nodes, counts, defaults).withColumn("__place", _place())
    dealt = counted.repartitionByRange("__place").sortWithinPartitions("__place")
    settled = cut(dealt.select("path", "quota").mapInArrow(_settle, _SETTLED), "settled")
    left = settled.where(F.col("open").isNull() | F.col("open")).repartition(1).sortWithinPartitions("block", "at")
    closed = left.mapInArrow(_close, _SETTLED)
    totals = settled.where(~F.col("open")).unionByName(closed).select("path", "taken")
    taken = totals.select(path_text("path").alias("node"), "taken")
    residual = F.when(F.col("quota").isNull(), 0).otherwise(F.greatest(F.col("quota") - F.col("taken"), F.lit(0))).cast("bigint")
    parent = F.when(F.col("depth") > 1, path_text(F.slice("path", 1, F.col("depth") - 1)))
    out = counted.drop("__place").join(taken, "node").withColumn("residual", residual)
    return out.select("node", "path", "ord", "depth", "quota", "residual", parent.alias("parent"), (F.col("taken") + F.col("residual")).alias("total"))


def allocation_leaves(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """(alloc, n, leaf, leaf_path, leaf_index, n_leaves, forced, tags, metadata, constraints): the leaves each allocation draws from.

    Leaves under a descendant with a quota of its own are left out; when none remain the
    allocation draws from all its leaves and every draw is a resample (``forced``).  Tags,
    metadata and constraints are inherited along the path below the allocation, the deeper key
    wins.  Leaves are numbered in ranges of the tree order, so an allocation over all leaves
    is many tasks' work.
    """
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    bound = nodes if "constraints" in nodes.columns else nodes.withColumn("constraints", empty)
    base = bound.select(path_text("path").alias("leaf"), "path", "ord", F.size("path").alias("depth"))
    parents = nodes.where(F.size("path") > 1).select(path_text(F.slice("path", 1, F.size("path") - 1)).alias("leaf")).distinct()
    leaves = base.join(parents, "leaf", "left_anti").withColumn("place", _place())
    leaves = cut(leaves.repartitionByRange("place").withColumn("range", F.spark_partition_id()), "tree-leaves")
    # The chain of a leaf is itself and its ancestors: one entry per level.
    chain = leaves.select("leaf", F.col("path").alias("p"), "place", "range", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("d")).select(
        "leaf", "p", "place", "range", "d", path_text(F.slice("p", 1, F.col("d"))).alias("node")
    )
    info = plan.select("node", "quota", "residual").join(bound.select(path_text("path").alias("node"), "tags", "metadata", "constraints"), "node")
    entry = F.struct(
        "d", "node", "residual", F.col("quota").isNotNull().alias("explicit"), "tags", F.map_entries("metadata").alias("metadata"), F.map_entries("constraints").alias("constraints")
    )
    steps = chain.join(info, "node").groupBy("leaf", "p", "place", "range").agg(F.array_sort(F.collect_list(entry)).alias("steps"))
    picked = steps.select("leaf", "p", "place", "range", "steps", F.explode("steps").alias("a")).where("a.residual > 0")
    lower = F.filter("steps", lambda s: s["d"] > F.col("a.d"))
    excluded = F.exists(lower, lambda s: (s["residual"] > 0) | ((s["d"] == F.col("a.d") + 1) & s["explicit"]))
    own = F.filter("steps", lambda s: s["d"] >= F.col("a.d"))
    tags = F.array_distinct(F.flatten(F.transform(own, lambda s: F.coalesce(s["tags"], F.array().cast("array<string>")))))
    rows = picked.select(
        F.col("a.node").alias("alloc"), F.col("a.residual").alias("n"), "leaf", F.col("p").alias("leaf_path"), "place", "range", excluded.alias("excluded"), tags.alias("tags"),
        _merged(own, "metadata").alias("metadata"), _merged(own, "constraints").alias("constraints"),
    )
    rows = cut(rows, "alloc-leaves")
    free = rows.groupBy("alloc").agg(F.count_if(~F.col("excluded")).alias("free"), F.count("*").alias("every"))
    sizes = free.select("alloc", (F.col("free") == 0).alias("forced"), F.when(F.col("free") == 0, F.col("every")).otherwise(F.col("free")).alias("n_leaves"))
    usable = rows.join(sizes, "alloc").where(F.col("forced") | ~F.col("excluded"))
    numbered = blockwise_row_number(usable, ["alloc"], [F.col("place")], F.col("range"), "no")
    return numbered.select("alloc", "n", "leaf", "leaf_path", (F.col("no") - 1).alias("leaf_index"), "n_leaves", "forced", "tags", "metadata", "constraints")


def _merged(steps: Column, field: str) -> Column:
    """A map of each step of the chain as one map; the deeper key wins."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))

    def step(acc: Column, s: Column) -> Column:
        over = F.coalesce(F.map_from_entries(s[field]), empty)
        return F.map_concat(F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)

    return F.aggregate(steps, empty, step)


def draw_themes(nodes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """One row per drawn sample, with the tags, metadata and constraints of its leaf's path.

    The first draws of an allocation take each of its leaves once, in order; further draws
    pick by hash and are ``resampled``.  Large quotas are unrolled in chunks, so one node's
    quota is spread over many tasks.
    """
    plan = cut(plan, "plan")
    leaves = cut(allocation_leaves(nodes, plan), "leaves")
    # Children come before their parent.  A range of the order sums its own quotas; one row a range meets the others.
    width = plan.where("residual > 0").select("node", F.col("residual").alias("n"), _place().alias("place"))
    width = cut(width.repartitionByRange("place").withColumn("range", F.spark_partition_id()), "quotas")
    ranges = width.groupBy("range").agg(F.sum("n").alias("t"))
    ranges = ranges.select(F.col("range").alias("r"), F.coalesce(F.sum("t").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = W.partitionBy("range").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    inner = width.withColumn("before_in_range", F.coalesce(F.sum("n").over(within), F.lit(0)))
    offsets = inner.join(F.broadcast(ranges), F.col("range") == F.col("r")).select(F.col("node").alias("alloc"), "n", (F.col("before_in_range") + F.col("before")).alias("offset"))
    per_alloc = leaves.select("alloc", "n_leaves", "forced").distinct()
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(DRAW_CHUNK)).cast("bigint"))).alias("chunk")
    spread = offsets.join(per_alloc, "alloc").select("alloc", "n", "offset", "n_leaves", "forced", chunk)
    first = F.col("chunk") * DRAW_CHUNK
    draws = spread.repartition("alloc", "chunk").select(
        "alloc", "offset", "n_leaves", "forced", F.explode(F.sequence(first, F.least(first + DRAW_CHUNK, F.col("n")) - 1)).alias("draw")
    )
    resampled = F.col("forced") | (F.col("draw") >= F.col("n_leaves"))
    index = F.when(resampled, draw_index(seed, F.col("n_leaves"), "alloc", F.col("draw").cast("string"))).otherwise(F.col("draw"))
    chosen = draws.select("alloc", "offset", "draw", resampled.alias("resampled"), index.alias("leaf_index"))
    joined = chosen.join(leaves.drop("n", "n_leaves", "forced"), ["alloc", "leaf_index"])
    path = F.col("leaf_path")
    n = F.size(path)
    category = F.get(path, F.lit(0))
    sub = F.when(n > 1, F.get(path, F.lit(1))).otherwise(category)
    return joined.select(
        F.concat(F.lit("sample_"), digits(F.col("offset") + F.col("draw") + 1, 6)).alias("sample_id"),
        (F.col("offset") + F.col("draw") + 1).alias("seq"),
        F.col("alloc").alias("quota_source_path"),
        F.col("leaf_path").alias("theme_path"),
        category.alias("category"),
        sub.alias("subcategory"),
        F.when(n > 2, F.element_at(path, n - 1)).otherwise(sub).alias("subtopic"),
        F.element_at(path, -1).alias("theme"),
        "resampled",
        "tags",
        "metadata",
        "constraints",
    )


def require_quota(plan: DataFrame) -> None:
    """Raises when no node has any quota; looks at one row."""
    if not plan.where("residual > 0").take(1):
        raise ValueError("no prompt quota was resolved")


# --- G4 -------------------------------------------------------------------------------
def _draft(pools: dict[str, list[str]], seed: Column | int, sample: Column | str) -> dict[str, Column]:
    out = {}
    for part, default in fixed.DRAFT_DEFAULTS.items():
        pool = pools.get(part) or []
        if not pool:
            out[part] = F.lit(default)
            continue
        key = F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), F.lit(part), sample if isinstance(sample, Column) else F.col(sample)))
        head = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
        out[part] = F.element_at(F.array(*[F.lit(v) for v in pool]), (F.pmod(head, F.lit(len(pool))) + 1).cast("int"))
    return out


def _render(draft: dict[str, Column], style: str) -> Column:
    return normalize_text(_sentence(draft, style))


def _sentence(draft: dict[str, Column], style: str) -> Column:
    theme = F.col("theme")
    d = draft
    if style == "keyword_list":
        return F.concat_ws(", ", theme, d["scene"], d["lighting"], d["weather"], d["subject_state"], d["camera"], d["realism_anchor"])
    if style == "short_sentence":
        return F.concat(
            theme, F.lit(" in "), d["scene"], F.lit(", with "), d["lighting"], F.lit(" and "), d["weather"],
            F.lit(", showing "), d["subject_state"], F.lit(" from "), d["camera"], F.lit("."),
        )
    return F.concat(
        theme, F.lit(". "), d["scene"], F.lit(". "), d["lighting"], F.lit(". "), d["weather"], F.lit(". The subject shows "),
        d["subject_state"], F.lit(". Seen from "), d["camera"], F.lit(". Preserve "), d["realism_anchor"], F.lit(" with grounded, realistic detail."),
    )


def compose_drafts(samples: DataFrame, pools: dict[str, list[str]], style: str = "detailed", seed: Column | int = 42) -> DataFrame:
    """Adds the six draft parts and the rendered ``prompt``; picks depend on seed and sample id only."""
    draft = _draft(pools, seed, "sample_id")
    return samples.withColumns({**draft, "prompt": _render(draft, style)})


# --- G5 -------------------------------------------------------------------------------
def dedupe_regenerate(drafts: DataFrame, pools: dict[str, list[str]], style: str = "detailed", seed: int = 42, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(drafts after up to ``passes`` rounds, log of regenerated rows).

    In each round every row that repeats an earlier one gets a new draw (its realism anchor
    stays); the first row of each group is left alone.  Only the repeats are written to the
    shared folder: the drafts are read anew by each round and must come out the same.
    """
    drawn = lambda rows, **how: _redrawn(drafts, rows.groupBy("seq").agg(F.max("dedupe_pass").alias("__pass")), pools, style, seed, **how)
    log = None
    for p in range(1, passes + 1):
        # the search normalizes texts by itself: new ones need not pass a Python worker before
        dup = cut(near_duplicates(drafts if log is None else drawn(log, plain=False), "prompt", "seq"), "repeats")
        events = dup.select("seq", "anchor_seq", F.lit(p).alias("dedupe_pass"))
        log = events if log is None else log.unionByName(events)
    return (drafts if log is None else drawn(log)), log


def _redrawn(drafts: DataFrame, passes: DataFrame, pools: dict[str, list[str]], style: str, seed: int, plain: bool = True) -> DataFrame:
    """``drafts`` with a new draw for the rows of ``passes`` (seq, __pass), by their last pass; ``plain``: its text is normalized."""
    again = F.col("__pass").isNotNull()
    fresh = _draft({k: v for k, v in pools.items() if k != "realism_anchor"}, F.concat(F.lit(f"{seed}:"), F.col("__pass").cast("string")), "sample_id")
    parts = {k: F.when(again, v).otherwise(F.col(k)) for k, v in fresh.items() if k != "realism_anchor" and pools.get(k)}
    met = drafts.join(broadcast_if_small(passes, BROADCAST_REPEATS), "seq", "left")
    met = met.withColumns(parts) if parts else met
    text = F.when(again, _sentence({k: F.col(k) for k in fixed.DRAFT_DEFAULTS}, style))
    text = normalize_text(text) if plain else text
    return met.withColumn("prompt", F.when(again, text).otherwise(F.col("prompt"))).select(*drafts.columns)
