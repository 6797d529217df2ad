"""A store of mergeable rows that a stream adds to, kept small by log-structured merging.

Every micro-batch writes its own folder, ``batch=<id>``.  ``compact`` folds the finished batches to
a run and, once ``FAN`` runs of one level have piled up, folds those to one run of the next level,
so a row is rewritten a logarithmic number of times and the number of folders stays bounded.
Which runs count, and up to which batch they reach, stands in a manifest; a new manifest appears
by one rename, under the next number, so a reader sees the old runs or the new ones, never a mix,
and of two compactions at once one fails.  Batches up to the manifest's bound are read from the
runs alone: a replayed old batch writes its folder again and counts once.  The newest batch is
never folded, since it is the one that a restart replays.  What a compaction replaces is removed by
the next one, so readers that are under way end on the files they began with.

With ``partition_by`` every folder is partitioned, so a reader that asks for some values of the
column touches their files only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fold = Callable[[DataFrame], DataFrame]
FAN = 8
BATCH = "batch"


class CompactionConflict(RuntimeError):
    """Another compaction has written the manifest first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    upto: int  # the last batch that the runs hold
    runs: tuple[tuple[str, int], ...]  # (folder, level), oldest first
    old: tuple[str, ...]  # folders that the next compaction removes


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, partition_by: str | None = None):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.schema = T.StructType([f for f in given.fields if f.name != BATCH]).add(BATCH, T.LongType())
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files ---
    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(where)) if self._files.exists(where) else []

    def batches(self) -> list[int]:
        """Ids of the batch folders there, in order."""
        return sorted(int(n.split("=")[1]) for n in self._names(self.path) if n.startswith(f"{BATCH}="))

    def manifest(self) -> Manifest:
        versions = [n for n in self._names(f"{self.path}/_manifest") if n.isdigit()]
        if not versions:
            return Manifest(0, -1, (), ())
        stream = self._files.open(self._at(f"{self.path}/_manifest/{versions[-1]}"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(found["version"], found["upto"], tuple((p, n) for p, n in found["runs"]), tuple(found["old"]))

    def _swap(self, manifest: Manifest) -> None:
        folder = f"{self.path}/_manifest"
        draft, final = self._at(f"{folder}/.draft-{uuid.uuid4().hex}"), self._at(f"{folder}/{manifest.version:020d}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps({"version": manifest.version, "upto": manifest.upto, "runs": manifest.runs, "old": manifest.old}).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise CompactionConflict(f"manifest {manifest.version} of {self.path} is there already")

    # --- rows ---
    def _written(self, rows: DataFrame, folder: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{folder}")

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a micro-batch; the same id again overwrites them."""
        self._written(rows.select(*[f.name for f in self.schema if f.name != BATCH]), f"{BATCH}={batch_id}")

    def _load(self, runs: Sequence[str], batches: Sequence[int]) -> DataFrame:
        plain = T.StructType([f for f in self.schema if f.name != BATCH])
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{r}") for r in runs]
        if batches:
            fresh = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/{BATCH}={b}" for b in batches])
            parts.append(fresh)
        if not parts:
            return self.spark.createDataFrame([], plain).withColumn(BATCH, F.lit(None).cast("bigint"))
        out = parts[0].select(*self.schema.names)
        for part in parts[1:]:
            out = out.unionByName(part.select(*self.schema.names))
        return out

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of batches below ``before``, which must not reach into a run; merged or not, with their ``batch``."""
        manifest = self.manifest()
        if before is not None and before <= manifest.upto:
            raise ValueError(f"batches up to {manifest.upto} are merged; rows before {before} cannot be told apart")
        fresh = [b for b in self.batches() if b > manifest.upto and (before is None or b < before)]
        return self._load([p for p, _ in manifest.runs], fresh)

    def compact(self, merge: Fold, least: int = FAN, fan: int = FAN) -> Manifest:
        """Folds ``least`` or more finished batches, and levels of ``fan`` runs, with ``merge``.

        ``merge`` must give the store's columns; without ``batch`` the newest id stands.
        """
        if fan < 2:
            raise ValueError("a level of one run would never be done merging")
        now = self.manifest()
        done = [b for b in self.batches()[:-1] if b > now.upto]
        runs, gone = list(now.runs), []
        upto = now.upto
        if len(done) >= max(least, 1):
            runs.append((self._run(merge, [], done, done[-1]), 1))
            upto = done[-1]
            gone += [f"{BATCH}={b}" for b in done]
        level = 1
        while len(full := [r for r in runs if r[1] == level]) >= fan:
            merged = (self._run(merge, [p for p, _ in full], [], upto), level + 1)
            runs = [r for r in runs if r[1] > level] + [merged] + [r for r in runs if r[1] < level]
            gone += [p for p, _ in full]
            level += 1
        if runs == list(now.runs):
            return now
        after = Manifest(now.version + 1, upto, tuple(runs), tuple(gone))
        self._swap(after)
        for folder in now.old:
            self._files.delete(self._at(f"{self.path}/{folder}"), True)
        for name in self._names(f"{self.path}/_manifest"):
            if name.isdigit() and int(name) < now.version:
                self._files.delete(self._at(f"{self.path}/_manifest/{name}"), False)
        return after

    def _run(self, merge: Fold, runs: Sequence[str], batches: Sequence[int], newest: int) -> str:
        merged = merge(self._load(runs, batches))
        if BATCH not in merged.columns:
            merged = merged.withColumn(BATCH, F.lit(newest).cast("bigint"))
        folder = f"_runs/{newest}-{uuid.uuid4().hex}"
        self._written(merged.select(*self.schema.names), folder)
        return folder
