"""Session factory with adaptive execution on and settings left to the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tessera", master: str | None = None, *, executor_memory: str | None = None, driver_memory: str | None = None, shuffle_partitions: int | None = None, timezone: str = "UTC", extra: dict[str, str] | None = None) -> SparkSession:
    """A session; unset options keep the cluster's own values."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": timezone,
        "spark.sql.parquet.compression.codec": "snappy",
        "spark.sql.sources.partitionOverwriteMode": "static",
    }
    named = {"spark.executor.memory": executor_memory, "spark.driver.memory": driver_memory, "spark.sql.shuffle.partitions": shuffle_partitions}
    conf |= {k: str(v) for k, v in named.items() if v is not None} | (extra or {})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate()


def stop_session(spark: SparkSession) -> None:
    spark.stop()
