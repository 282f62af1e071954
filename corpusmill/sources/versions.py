"""A keyed table kept as Parquet folders: each write adds a folder, none is ever rewritten.

    <root>/base=<b>/rows/v=<n>      rows added by version n
    <root>/base=<b>/removed/v=<n>   keys that version n takes out of all earlier ones
    <root>/base=<b>/sizes/v=<n>;…   an empty folder whose name tells rows and bytes of those keys
    <root>/retired/base=<b>         an empty folder: the base counts as absent

A version counts once Spark has marked its rows folder as complete, so a job that dies half-way
changes nothing. A batch costs what the batch weighs: stored rows are neither read in full nor
written again. `compact` folds the versions into a new base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import BROADCAST_BYTES, BROADCAST_ROWS, measured
from corpusmill.sources.folders import child_folders, exists, make_folder

DONE = "_SUCCESS"


class ConcurrentWriteError(RuntimeError):
    """Another writer took the version this one was about to write."""


class VersionedTable:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        key: str = "id",
        partition_by: Sequence[str] = (),
        sort_by: Sequence[str | Column] = (),
    ):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.partition_by, self.sort_by = list(partition_by), list(sort_by)

    def _numbered(self, folder: str, prefix: str) -> list[int]:
        names = [n for n in child_folders(self.spark, folder) if n.startswith(prefix + "=")]
        return sorted(int(n.split("=", 1)[1]) for n in names)

    def _versions(self, base: int) -> list[int]:
        rows = f"{self.root}/base={base}/rows"
        return [v for v in self._numbered(rows, "v") if exists(self.spark, f"{rows}/v={v}/{DONE}")]

    def base(self) -> int | None:
        """The newest base that holds a complete version, None when there is none."""
        retired = self._numbered(f"{self.root}/retired", "base")
        for base in reversed(self._numbered(self.root, "base")):
            if base not in retired and self._versions(base):
                return base
        return None

    def version(self) -> tuple[int, int] | None:
        """The newest base and its newest complete version, None when there is none."""
        base = self.base()
        return None if base is None else (base, self._versions(base)[-1])

    def exists(self) -> bool:
        return self.base() is not None

    def _read_folders(self, folder: str, versions: list[int], schema: T.StructType) -> DataFrame:
        schema = T.StructType([*schema.fields, T.StructField("v", T.IntegerType())])
        paths = [f"{folder}/v={v}" for v in versions]
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*paths)

    def read(self) -> DataFrame:
        """The live rows."""
        base = self.base()
        if base is None:
            raise FileNotFoundError(f"no complete table at {self.root}")
        folder = f"{self.root}/base={base}"
        versions = self._versions(base)
        rows = self._read_folders(f"{folder}/rows", versions, self.schema)
        removals = [v for v in self._numbered(f"{folder}/removed", "v") if v in versions]
        names = self.schema.fieldNames()
        if not removals:
            return rows.select(*names)
        key_schema = T.StructType([self.schema[self.key]])
        removed = self._read_folders(f"{folder}/removed", removals, key_schema)
        last = removed.groupBy(self.key).agg(F.max("v").alias("removed_at"))
        # The keys were measured when written: without a broadcast every row would shuffle with its body.
        if self._removals_fit(folder, removals):
            last = F.broadcast(last)
        live = F.col("removed_at").isNull() | (F.col("v") >= F.col("removed_at"))
        return rows.join(last, self.key, "left").where(live).select(*names)

    def newest(self) -> DataFrame:
        """The rows that the newest version added."""
        base, version = self.version()
        return self._read_folders(f"{self.root}/base={base}/rows", [version], self.schema).select(*self.schema.fieldNames())

    def _removals_fit(self, folder: str, removals: list[int]) -> bool:
        """Whether the removed keys, as noted beside them, fit a broadcast; unmeasured keys do not."""
        sizes = {}
        for name in child_folders(self.spark, f"{folder}/sizes"):
            version, n_rows, n_bytes = (int(part.split("=")[1]) for part in name.split(";"))
            sizes[version] = n_rows, n_bytes
        if not set(removals) <= set(sizes):
            return False
        n_rows, n_bytes = (sum(sizes[v][i] for v in removals) for i in (0, 1))
        return n_rows <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES

    def _write(self, rows: DataFrame, location: str) -> None:
        if exists(self.spark, location):
            raise ConcurrentWriteError(f"{location} is there already")
        rows = rows.select(*self.schema.fieldNames())
        if self.partition_by:
            # Few files per folder; adaptive execution splits a folder that is large.
            rows = rows.hint("rebalance", *self.partition_by)
        if self.sort_by:
            rows = rows.sortWithinPartitions(*self.sort_by)
        rows.write.mode("error").partitionBy(*self.partition_by).parquet(location)

    def append(self, rows: DataFrame, removed: DataFrame | None = None) -> None:
        """Add rows and take out keys as one version; the rows folder completes it."""
        base = self.base()
        if base is None:
            raise FileNotFoundError(f"no complete table at {self.root}")
        folder = f"{self.root}/base={base}"
        # Numbers an unfinished version left behind are not used again.
        taken = [*self._numbered(f"{folder}/rows", "v"), *self._numbered(f"{folder}/removed", "v")]
        version = max(taken) + 1
        if removed is not None:
            keys = f"{folder}/removed/v={version}"
            removed.select(self.key).write.mode("error").parquet(keys)
            n_rows, n_bytes = measured(self.spark.read.parquet(keys))
            make_folder(self.spark, f"{folder}/sizes/v={version};rows={n_rows};bytes={n_bytes}")
        self._write(rows, f"{folder}/rows/v={version}")

    def remove(self, keys: DataFrame) -> None:
        self.append(self.spark.createDataFrame([], self.schema), keys)

    def replace(self, rows: DataFrame) -> None:
        """Start a new base holding just these rows."""
        bases = self._numbered(self.root, "base")
        self._write(rows, f"{self.root}/base={bases[-1] + 1 if bases else 0}/rows/v=0")

    def compact(self) -> None:
        self.replace(self.read())

    def retire(self) -> None:
        """Make the table count as absent, newest base last, so that an older one never comes to light; the files stay."""
        for base in self._numbered(self.root, "base"):
            make_folder(self.spark, f"{self.root}/retired/base={base}")
