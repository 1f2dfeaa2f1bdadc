"""Versioned tables over Parquet: snapshots, appends, overwrites, merges, time travel.

A version is a small JSON manifest that lists data folders.  An append writes one new
folder and a manifest that adds it; readers of older versions are not disturbed.  The
manifest is written under a temporary name and renamed, so a version appears whole or
not at all.  Paths go through Hadoop's file system, so any store that Spark reaches
will do.  One writer per table at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def tables(self) -> list[str]:
        top = self._path()
        fs = self._fs(top)
        return sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()) if fs.exists(top) else []

    def versions(self, table: str) -> list[int]:
        log = self._path(table, "_log")
        fs = self._fs(log)
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def _manifest(self, table: str, version: int | None) -> dict:
        known = self.versions(table)
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {version if version is not None else ''} of table {table!r}")
        path = self._path(table, "_log", f"{known[-1] if version is None else version:08d}.json")
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, table: str, folders: list[str], operation: str) -> int:
        version = (self.versions(table) or [-1])[-1] + 1
        hidden, final = self._path(table, "_log", f".{uuid.uuid4().hex}"), self._path(table, "_log", f"{version:08d}.json")
        fs = self._fs(final)
        out = fs.create(hidden)
        out.write(bytearray(json.dumps({"folders": folders, "operation": operation}).encode()))
        out.close()
        if not fs.rename(hidden, final):
            raise RuntimeError(f"version {version} of {table} was written by somebody else")
        return version

    def _write(self, df: DataFrame, table: str, partition_cols: Sequence[str]) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", 5_000_000)
        (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(f"{self.root}/{table}/{folder}")
        return folder

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version; columns added later are null in older rows."""
        frames = [self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}/{f}") for f in self._manifest(table, version)["folders"]]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def append(self, df: DataFrame, table: str, partition_cols: Sequence[str] = ()) -> int:
        old = self._manifest(table, None)["folders"] if self.exists(table) else []
        return self._commit(table, [*old, self._write(df, table, partition_cols)], "append")

    def overwrite(self, df: DataFrame, table: str, partition_cols: Sequence[str] = ()) -> int:
        return self._commit(table, [self._write(df, table, partition_cols)], "overwrite")

    def merge(self, df: DataFrame, table: str, keys: Sequence[str]) -> int:
        """Rows of ``df`` replace rows with equal keys; the others stay."""
        if not self.exists(table):
            return self.overwrite(df, table)
        old = self.read(table)
        return self.overwrite(old.join(df.select(*keys).distinct(), list(keys), "left_anti").unionByName(df, allowMissingColumns=True), table)

    def delete(self, table: str, condition: str) -> int:
        """Deletes rows where the condition is true; null keeps the row."""
        return self.overwrite(self.read(table).filter(~F.coalesce(F.expr(condition), F.lit(False))), table)

    def vacuum(self, table: str, keep: int = 1) -> list[str]:
        """Drops versions but the last ``keep``, and data folders no kept version lists."""
        known = self.versions(table)
        kept = {f for v in known[-keep:] for f in self._manifest(table, v)["folders"]}
        top = self._path(table)
        fs = self._fs(top)
        gone = [n for s in fs.listStatus(top) if (n := s.getPath().getName()).startswith("data-") and n not in kept]
        for v in known[:-keep]:
            fs.delete(self._path(table, "_log", f"{v:08d}.json"), False)
        for n in gone:
            fs.delete(self._path(table, n), True)
        return gone
