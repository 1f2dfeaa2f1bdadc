"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.sources.shared import forgotten, written

def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _with_minimum(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v), ``n`` at most, with ``m``, the smallest v of their u.

    Hubs have a thousandth of the edges or more, so they are a thousand at most; they are broadcast with
    their minima and their edges stay where they are.  The rest is a window: no other table is joined, so none
    is sent through the driver, however small the optimizer takes it for.  ``edges`` is read three times.
    """
    least = F.min("v").over(Window.partitionBy("u"))
    found = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    hubs = written(found.filter(F.col("degree") >= F.lit(max(1, n // joins.HOT_KEYS))).drop("degree"), "hubs")
    if hubs.isEmpty():
        return edges.withColumn("m", least)
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return edges.join(F.broadcast(hubs), "u").unionByName(others.withColumn("m", least))


def _contracted(e: DataFrame) -> DataFrame:
    """Large-star and small-star over few edges: each star is a window, so a round is three shuffles of one table that is read once."""
    least = F.min("v").over(Window.partitionBy("u"))

    def each(*pairs: tuple[str, str]):
        return F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs]))

    large = e.select(each(("u", "v"), ("v", "u"))).withColumn("m", F.least("u", least)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.withColumn("m", least).select(each(("u", "m"), ("v", "m"))).filter("u > v").distinct()


def _contracted_around_hubs(e: DataFrame, n: int) -> DataFrame:
    """The same over many edges (``n``): the edges of hubs stay where they are."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_minimum(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    large = written(large, "large-star")
    small = _with_minimum(large, n)
    return small.select(F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in ("u", "v")]))).filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches.

    Large-star links a node's larger neighbours to its smallest one, small-star
    links its smaller neighbours to the smallest; in a few rounds every component
    is a star.  A round is two aggregations and two windows over the edge
    table, written to the shared folder, so lineage does not grow; the edges of hubs stay
    where they are and no task sees all of them.  Up to half of MANY_ROWS edges, where a hub
    is small too, nothing looks for hubs: the plan and its tasks, which the
    driver has to keep account of, are fewer.  Loops and null ends are ignored.  The rounds follow the
    logarithm of the longest path; RuntimeError if ``max_rounds`` do not settle it.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v AND v IS NOT NULL").distinct()
    e, seen = written(e, "edges"), None
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        few = 2 * seen[0] <= joins.MANY_ROWS
        before, e = e, written(_contracted(e) if few else _contracted_around_hubs(e, seen[0]), "edges")
        now = _fingerprint(e)
        forgotten(before)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    leaves = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
