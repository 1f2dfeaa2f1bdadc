"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where
that is unset and the master is local (tests, notebooks) does the library make one of
its own; a cluster without it is an error, as executors share no other folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees a query's shuffle files as soon as it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds Arrow batches on their way to Python workers by bytes, beside the number of rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Written tables by session, oldest first.
_made: dict[str, list[str]] = {}


def _tables(spark: SparkSession) -> list[str]:
    return _made.setdefault(spark._jsparkSession.sessionUUID(), [])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a fresh local one where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir names no folder, and executors of {master} share no local one")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, *, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there.

    A lost executor costs a reread of that table, never a recomputation, and
    every later reader sees the same rows.  The table's size is known, so the
    optimizer can decide on broadcasts by it.  ``keep`` spares it from ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    if not keep:
        _tables(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, limit: int = 4 << 20):
    """Inside, Arrow batches end beyond ``limit`` bytes: executor and worker hold a batch each, and 10000 rows of text are tens of MB."""
    return _setting(spark, BATCH_BYTES, str(limit))


def forgotten(table: DataFrame) -> None:
    """Deletes a table that ``written`` returned and that no later step reads."""
    spark = table.sparkSession
    dropped(spark, table._tessera_path)
    if table._tessera_path in _tables(spark):
        _tables(spark).remove(table._tessera_path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables written inside that are not kept.

    What is still to be computed from them must be written with ``keep`` before.
    """
    made = _tables(spark)
    before = set(made)
    try:
        yield
    finally:
        for path in [p for p in made if p not in before]:
            dropped(spark, path)
            made.remove(path)
