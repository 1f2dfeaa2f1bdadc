"""Deduplication, row picks and rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import forgotten, written


def deduplicate(df: DataFrame, keys: Sequence[str], order_col: str, *, ascending: bool = False, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """One row per key: the latest (or earliest); ties by ``tie_breakers``."""
    first = F.col(order_col).asc_nulls_last() if ascending else F.col(order_col).desc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(first, *tie_breakers)
    return df.withColumn("__tessera_rn", F.row_number().over(w)).filter("__tessera_rn = 1").drop("__tessera_rn")


def drop_duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys) if keys else None)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """A global 1-based row number without a single-partition sort, and the number of rows.

    Rows are range-partitioned and numbered per partition; the sorted rows are
    written once, so that offsets and rows agree, and the offsets (one per partition)
    are joined.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__tessera_place", F.monotonically_increasing_id())
    ranged = written(ranged, "ranked")
    parts = ranged.groupBy(F.shiftright("__tessera_place", 33).alias("__tessera_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("__tessera_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__tessera_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("__tessera_offset"))
    total = parts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = ranged.withColumn("__tessera_part", F.shiftright("__tessera_place", 33)).join(offsets, "__tessera_part")
    number = F.col("__tessera_offset") + F.col("__tessera_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(name, number).drop("__tessera_part", "__tessera_offset", "__tessera_place"), total


def exact_percentiles(df: DataFrame, values: dict[str, Column], fractions: Sequence[float]) -> dict[str, list[float] | None]:
    """What ``percentile`` gives for each of ``values`` (as doubles), without a task that holds all of them; None where there are none.

    Values are counted in one long form, range-partitioned and written once.  The driver gets
    one sum per partition; only partitions in which a wanted rank falls are added up value by value.
    """
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), v.cast("double").alias("v")) for i, v in enumerate(values.values())])
    counted = df.select(F.inline(pairs)).filter("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    table = written(counted.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), "counted")
    sums: list[list[tuple[int, int]]] = [[] for _ in values]
    for c, part, n in sorted(map(tuple, table.groupBy("c", "part").agg(F.sum("n")).collect())):
        sums[c].append((part, n))
    totals = [sum(n for _, n in own) for own in sums]
    places = {(c, (total - 1) * p) for c, total in enumerate(totals) if total for p in fractions}
    wanted = []
    for c, rank in {(c, f(x)) for c, x in places for f in (math.floor, math.ceil)}:
        before = 0
        for part, n in sums[c]:
            if before <= rank < before + n:
                wanted.append((c, part, rank - before, rank))
            before += n
    found = {}
    if wanted:
        near = table.filter(F.col("part").isin(sorted({w[1] for w in wanted})))
        near = near.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "part").orderBy("v")))
        ranks = F.broadcast(spark.createDataFrame(wanted, "c int, part int, k long, rank long"))
        rows = near.join(ranks, ["c", "part"]).filter("upto > k AND upto - n <= k").select("c", "rank", "v").collect()
        found = {(r.c, r.rank): r.v for r in rows}
    forgotten(table)

    def at(c: int, place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        a, b = found[c, low], found[c, high]
        return a if low == high or a == b else (high - place) * a + (place - low) * b

    return {name: [at(c, (totals[c] - 1) * p) for p in fractions] if totals[c] else None for c, name in enumerate(values)}


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def union_by_name(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def erase(tables: dict[str, DataFrame], key: str, subjects: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the given subjects (right to erasure); null keys stay."""
    return {n: t.join(subjects.select(key).distinct(), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)
