"""Components of the whole line item table against union-find."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, joins
from tessera.plans import catalogue
from tessera.sources import shared


def test_components_of_all_line_items_have_many_hops(spark, sf):
    keys = {r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().collect()}
    parent = {k: k for p in keys for k in (p, p + 7)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in sorted(keys):
        low, high = sorted((root(p), root(p + 7)))
        parent[high] = low
    got = {r.node: r.component for r in catalogue.QUERIES["components_whole"](spark, sf).collect()}
    assert got == {k: root(k) for k in parent}
    assert max(k - c for k, c in got.items()) > 7 * 10


def _components(edges):
    parent = {k: k for e in edges for k in e if None not in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    return {k: root(k) for e in edges if None not in e and e[0] != e[1] for k in e}


def test_hubs_chains_and_repeats_with_and_without_hub_joins(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1150)] + [(5000 - k, 5001 - k) for k in range(120)]
    edges += [(rng.randrange(6000, 6500), rng.randrange(6000, 6500)) for _ in range(300)] + [(7, 7), (None, 3), (0, 1), (1, 0)]
    table = spark.createDataFrame(edges, "a long, b long")
    for most in (joins.MANY_ROWS, 10):
        monkeypatch.setattr(joins, "MANY_ROWS", most)
        monkeypatch.setattr(joins, "HOT_KEYS", 20)
        got = {r.node: r.component for r in graph.connected_components(table, "a", "b").collect()}
        assert got == _components(edges)
    with pytest.raises(RuntimeError):
        graph.connected_components(table, "a", "b", max_rounds=1)
    assert graph.connected_components(table.limit(0), "a", "b").count() == 0


def test_a_round_over_few_edges_shuffles_three_times_and_reads_its_table_once(spark, monkeypatch):
    plans = []

    def written(df, label, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.written(df, label, **options)

    monkeypatch.setattr(graph, "written", written)
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 140)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(table, "a", "b").collect()}
    assert got == _components(edges)
    rounds = plans[1:]
    assert rounds and all(p.count("FileScan") == 1 and p.count("Exchange") == 3 for p in rounds)


def test_rounds_over_many_edges_send_nothing_but_hubs_through_the_driver(spark, monkeypatch):
    plans, hubs = [], []

    def written(df, label, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = shared.written(df, label, **options)
        if label == "hubs":
            hubs.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", written)
    monkeypatch.setattr(joins, "MANY_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_KEYS", 20)
    for edges, most in (([(k, k + 1) for k in range(0, 800, 2)], 0), ([(k, k + 7) for k in range(500)] + [(1000, k) for k in range(2000, 2300)], 80)):
        plans.clear(), hubs.clear()
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == _components(edges)
        assert hubs and max(hubs) <= most and (max(hubs) > 0) == (most > 0)
        for p in plans:
            sides = p.split("BroadcastExchange")[1:]
            assert "SortMergeJoin" not in p and all("/hubs-" in x.split("FileScan")[1] for x in sides), p
            assert most or not sides, p


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_scratch_deletes_what_is_not_kept_and_settings_stay(spark):
    before = spark.conf.get(shared.CLEANUP, None)
    with shared.scratch(spark):
        kept, gone = shared.written(spark.range(3).toDF("id"), "kept", keep=True), shared.written(spark.range(3).toDF("id"), "gone")
        gone.count()
    assert kept.count() == 3 and spark.conf.get(shared.CLEANUP, None) == before
    with pytest.raises(Exception):
        spark.read.parquet(gone._tessera_path).count()
    shared.forgotten(kept)


def test_join_with_hot_keys_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "MANY_ROWS", 0)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(200)] + [(None, -1)], "k int, x int")
    table = rows.filter("k IS NOT NULL AND k <> 3").groupBy("k").count().withColumnRenamed("count", "n").withColumn("y", F.col("k") * 10)
    for keys in (1, 5, 1000):
        monkeypatch.setattr(joins, "HOT_KEYS", keys)
        got = joins.join_with_hot_keys(rows, table, ["k"], "n", 201)
        assert got.columns == ["k", "x", "y"]
        assert sorted(map(tuple, got.collect())) == sorted((k, x, 10 * k) for k, x in map(tuple, rows.collect()) if k not in (None, 3))


def test_rows_without_a_key_are_all_quarantined(spark):
    from tessera.plans.medallion import bronze_to_silver

    rows = [("a", "c1", "5.0", "2024-01-01"), ("a", "c1", "6.0", "2024-01-02"), (None, "c2", "7.0", "2024-01-01"), (None, "c2", "7.0", "2024-01-01"), (None, None, "x", None), ("b", None, "1", "2024-01-01")]
    silver, bad = bronze_to_silver(spark.createDataFrame(rows, "order_id string, customer_id string, order_value string, order_timestamp string"), "run")
    assert [(r.order_id, r.order_value) for r in silver.collect()] == [("a", 6.0)]
    assert sorted(str(r.order_id) for r in bad.collect()) == ["None", "None", "None", "b"]


def test_upserts_take_the_last_row_and_keep_clashing_columns(spark):
    from tessera.operators.ranking import global_row_number
    from tessera.streaming.ingest import upsert_batches

    rows = spark.createDataFrame([(1, 5, "old", 0), (1, 9, "new", 0), (2, 1, "only", 7)], "k int, t int, v string, _rn int")
    got = []
    upsert_batches(["k"], "t", lambda df, batch: got.extend((batch, *r) for r in df.collect()))(rows, 4)
    assert sorted(got) == [(4, 1, 9, "new", 0), (4, 2, 1, "only", 7)]
    clash = rows.select("k", F.col("t").alias("_place"), F.col("v").alias("_part"))
    out, n = global_row_number(clash, [F.col("_place").asc()])
    assert n == 3 and sorted((r.row_number, r._place, r._part) for r in out.collect()) == [(1, 1, "only"), (2, 5, "old"), (3, 9, "new")]
