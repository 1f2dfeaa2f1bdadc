"""Slowly changing dimensions, type 2, as one plan over one snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import row_hash

META = ("_valid_from", "_valid_to", "_is_current", "_version", "_hash")


def initialise(df: DataFrame, tracked: Sequence[str], as_of: str) -> DataFrame:
    return df.withColumns({
        "_valid_from": F.lit(as_of).cast("timestamp"), "_valid_to": F.lit(None).cast("timestamp"), "_is_current": F.lit(True), "_version": F.lit(1), "_hash": row_hash(tracked),
    })


def apply_changes(current: DataFrame, incoming: DataFrame, keys: Sequence[str], tracked: Sequence[str], as_of: str) -> DataFrame:
    """The next snapshot: changed keys' rows expire, new versions follow their highest.

    Unchanged and missing keys stay as they are.  One row per key is expected in
    ``incoming``; both sides are read once, so nothing is seen half-merged.
    """
    now = F.lit(as_of).cast("timestamp")
    state = current.groupBy(*keys).agg(F.max("_version").alias("_last"), F.max(F.when(F.col("_is_current"), F.col("_hash"))).alias("_old"))
    fresh = incoming.withColumn("_hash", row_hash(tracked)).join(state, list(keys), "left")
    fresh = fresh.filter(F.col("_old").isNull() | (F.col("_old") != F.col("_hash")))
    new = fresh.withColumns({"_valid_from": now, "_valid_to": F.lit(None).cast("timestamp"), "_is_current": F.lit(True), "_version": (F.coalesce("_last", F.lit(0)) + 1).cast("int")})
    new = new.select(*current.columns)
    changed = fresh.filter("_old IS NOT NULL").select(*keys).withColumn("_expire", F.lit(True))
    kept = current.join(changed, list(keys), "left")
    expire = F.coalesce(F.col("_expire"), F.lit(False)) & F.col("_is_current")
    kept = kept.withColumns({"_valid_to": F.when(expire, now).otherwise(F.col("_valid_to")), "_is_current": F.when(expire, F.lit(False)).otherwise(F.col("_is_current"))})
    return kept.select(*current.columns).unionByName(new)
