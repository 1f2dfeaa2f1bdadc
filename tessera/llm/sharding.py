"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into memory-sized buckets by seeded hashes of the
key; pass two loads one bucket at a time, puts it in a fixed order, applies a
Fisher-Yates shuffle and hands the rows on in that order.  A shard is a run of
buckets, so slots within a shard are gapless.

Law ``key``: the shard is the one whose seeded hash with the key is largest
(rendezvous hashing).  The key and the number of shards decide alone, and one
more shard takes rows only into itself.

Null text counts as empty, a null key is a key of its own, rows repeated in full
get slots of their own, an empty table gives no rows.  Rows that share a key share
its shard, but their texts spread them over its buckets.  Input columns named as
an output (``shard``, ``slot``, ``grown_shard``) are replaced; names that start with
``__tessera`` are reserved.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BYTES = 8 << 20
ROW_OVERHEAD = 8


def rendezvous_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with ``key`` is largest; ties go to the higher number."""
    scores = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(j), key).alias("h"), F.lit(j).alias("j")) for j in range(shards)])
    return F.array_max(scores)["j"].cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def _shuffle_buckets(batches: Iterator[pa.RecordBatch], seed: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, bucket, key...), before them a row with the bucket's first slot; each bucket is held, shuffled and passed on."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        first = table.column("__tessera_base")[0].as_py()
        table = table.slice(1).combine_chunks()
        shard, bucket = table.column("shard")[0].as_py(), table.column("__tessera_bucket")[0].as_py()
        order = list(range(len(table)))
        random.Random(f"{seed}/{shard}/{bucket}").shuffle(order)  # Fisher-Yates
        mixed = table.select(names).take(pa.array(order)).append_column("slot", pa.array(range(first, first + len(order)), pa.int64()))
        return mixed.combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("shard").to_pylist(), batch.column("__tessera_bucket").to_pylist(), strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield emit(held)
                held, start, now = [], i, key
        held.append(batch.slice(start))
    if held:
        yield emit(held)


def shuffled_shards(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` and ``grown_shard`` (the shard if there were one more).

    Rows of a bucket leave in their shuffled order.  The number of buckets follows
    from the total size.  The first slot of each bucket (one row per bucket) is dealt
    and sorted in with its rows, so whole rows move once, nothing is joined and
    nothing collected.
    """
    docs = docs.drop("shard", "slot", "grown_shard")
    total = docs.agg(F.coalesce(F.sum(record_size(F.col(text_col))), F.lit(0))).first()[0]
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    key = F.col(key_col)
    tagged = docs.withColumns({
        "shard": rendezvous_shard(key, shards, seed),
        "grown_shard": rendezvous_shard(key, shards + 1, seed),
        "__tessera_bucket": F.pmod(F.xxhash64(F.lit(seed + 1), key, F.col(text_col)), F.lit(per_shard)).cast("int"),
    })
    counts = tagged.groupBy("shard", "__tessera_bucket").agg(F.count("*").alias("__tessera_n"))
    earlier = Window.partitionBy("shard").orderBy("__tessera_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "__tessera_bucket", F.coalesce(F.sum("__tessera_n").over(earlier), F.lit(0)).alias("__tessera_base"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(shards * per_shard, 1 << 16))
    rows = tagged.unionByName(base, allowMissingColumns=True).repartition(parts, "shard", "__tessera_bucket")
    rows = rows.sortWithinPartitions("shard", "__tessera_bucket", F.col("__tessera_base").asc_nulls_last(), key_col, text_col)
    names = [*docs.columns, "shard", "grown_shard"]
    schema = rows.select(names).schema.add("slot", T.LongType())
    placed = rows.mapInArrow(lambda it: _shuffle_buckets(it, seed, names), schema)
    return placed.select(*docs.columns, "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet, one folder per shard, rows in slot order."""
    placed = shuffled_shards(docs, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
