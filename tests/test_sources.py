from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import logs
from tessera.plans import medallion
from tessera.session import get_session
from tessera.sources import contracts, generators, ingest
from tessera.sources.store import SnapshotStore
from tessera.streaming import ingest as streaming


def test_readers_and_source_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y"), (2, "z")], "a int, b string")
    df.write.parquet(str(tmp_path / "p"))
    df.write.option("header", True).csv(str(tmp_path / "c"))
    (tmp_path / "j.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert ingest.read_parquet(spark, str(tmp_path / "p")).count() == 2
    assert {r.a for r in ingest.read_csv(spark, str(tmp_path / "c")).collect()} == {1, 2}
    assert ingest.read_json(spark, str(tmp_path / "j.json")).count() == 2
    assert "part-" in ingest.with_source_file(spark.read.parquet(str(tmp_path / "p"))).first()._source_file


def test_incremental_mark_follows_events(spark, tmp_path):
    path, marks = str(tmp_path / "t"), ingest.Watermarks(str(tmp_path / "w.json"))
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05")], "id int, d string").withColumn("d", F.to_timestamp("d")).write.parquet(path)
    new, advance = ingest.load_incremental(spark, path, "t", "d", marks)
    assert new.count() == 2
    advance()
    spark.createDataFrame([(3, "2024-01-06")], "id int, d string").withColumn("d", F.to_timestamp("d")).write.mode("append").parquet(path)
    new, advance = ingest.load_incremental(spark, path, "t", "d", marks)
    assert [r.id for r in new.collect()] == [3]
    assert "PushedFilters" in new._jdf.queryExecution().toString() or "DataFilters" in new._jdf.queryExecution().toString()
    advance()
    assert ingest.load_incremental(spark, path, "t", "d", marks)[0].count() == 0


def test_store_versions_merge_delete_vacuum(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    row = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert s.append(row((1, "a")), "t") == 0 and s.append(row((2, "b")).withColumn("x", F.lit(5)), "t") == 1
    assert s.read("t").columns == ["k", "v", "x"] and s.read("t", 0).count() == 1
    s.merge(row((2, "c"), (3, "d")), "t", ["k"])
    assert {(r.k, r.v) for r in s.read("t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    s.delete("t", "v = 'a' OR x > 100")
    assert s.read("t").count() == 2 and s.read("t", 1).count() == 2 and s.tables() == ["t"]
    assert s.vacuum("t") and s.versions("t") == [4 - 1] and s.read("t").count() == 2
    with pytest.raises(ValueError):
        s.read("t", 0)


def test_drift_goes_to_quarantine_only(spark, tmp_path):
    s, heard = SnapshotStore(spark, str(tmp_path / "store")), []
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    assert ingest.write_bronze(s, a, "b", batch_id="1")["written"]
    wider = ingest.write_bronze(s, a.withColumn("w", F.lit(1)), "b", batch_id="2", alert=lambda t, d: heard.append(d))
    assert wider["written"] and heard[0]["added"] == ["w"]
    bad = ingest.write_bronze(s, a.withColumn("id", F.col("id").cast("string")), "b", batch_id="3")
    assert not bad["written"] and s.read("b").count() == 2 and s.read("b_drift_quarantine").count() == 1
    assert {"_ingested_at", "_source_file", "_batch_id", "_has_drift"} <= set(s.read("b").columns)
    assert ingest.write_quarantine(s, a.limit(0), "q") is None and ingest.write_quarantine(s, a, "q") == 0


def test_registry_round_trips_schemas(spark, tmp_path):
    r = ingest.SchemaRegistry(str(tmp_path / "reg"))
    df = spark.createDataFrame([(1, [1.5], {"a": "b"})], "id int, xs array<double>, m map<string,string>")
    assert not ingest.detect_reference_drift(df, r, "t")["has_drift"] and r.get_schema("t") == df.schema
    d = ingest.detect_reference_drift(df.drop("m").withColumn("id", F.lit("x")), r, "t")
    assert d["removed"] == ["m"] and d["type_changes"][0]["column"] == "id" and r.list_schemas() == ["t"]
    assert r.register_schema("t", df.schema) == 1 and r.register_schema("t", df.drop("m").schema) == 2 and r.get_schema("t", 1) == df.schema
    assert ingest.get_schema("SILVER") == ingest.SILVER_SCHEMA
    with pytest.raises(ValueError):
        ingest.get_schema("lead")


def test_contracts_and_config_yaml(tmp_path):
    reg = contracts.ContractRegistry(str(tmp_path))
    reg.register(contracts.DataContract("c", "2.0.0", consumers=["x"]))
    (tmp_path / "broken.yaml").write_text("a: [")
    again = contracts.ContractRegistry(str(tmp_path))
    assert again.get("c").version == "2.0.0" and again.get_consumers("c") == ["x"] and again.get("d") is None and len(again.list_all()) == 1
    (tmp_path / "conf.yml").write_text("quality:\n  window: 7\nother: 1\n")
    assert contracts.load_config(str(tmp_path / "conf.yml")).quality.window == 7 and contracts.load_config("/none").quality.window == 20


def test_generators_are_seeded_and_faulty(spark, tmp_path):
    c, o = generators.customers(spark, 500), generators.orders(spark, 2000, 500)
    assert sorted(map(tuple, c.collect()), key=repr) == sorted(map(tuple, generators.customers(spark, 500).collect()), key=repr) and 500 < c.count() < 540
    assert 0.005 < o.filter("order_value < 0").count() / 2000 < 0.05 and generators.order_items(spark, 10, 5).count() == 10
    assert generators.products(spark, 10).count() == 10 and generators.reviews(spark, 10, 5).count() == 10
    issues = generators.inject_issues(o)
    assert issues.count() > 2000 and issues.filter("customer_id IS NULL").count() > 40
    notes = o.withColumn("delivery_notes", F.lit("leave at the door"))
    for name, profile in generators.PROFILES.items():
        p = generators.poisoned(notes, profile)
        kinds = {r.poison for r in generators.poison_summary(p).collect()}
        assert kinds == {"clean", *profile} or name == "full_chaos"
    for f in ("json", "csv", "parquet"):
        generators.write_records(p, str(tmp_path / f), f)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == p.count()
    assert {generators.load_profile(x)["pii_leak"] for x in generators.save_profiles(str(tmp_path / "y")) if "pii_heavy" in x} == {0.5}
    assert set(generators.generate_all(spark, 5, 5, 5, 5, 5)) == {"customers", "products", "orders", "reviews", "order_items"}
    assert p.filter("_poison = 'schema_break' AND order_value <> 'not_a_number'").count() == 0


def test_medallion_run(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "lake"))
    o = generators.orders(spark, 800, 100)
    out = medallion.run(store, generators.inject_issues(o), generators.customers(spark, 100), "r1", "2025-01-31")
    assert out["decision"] in ("PASS", "WARN") and out["pii_audit"]["status"] == "PASS" and set(out["seconds"]) == {"bronze", "silver", "gate", "gold", "pii_audit"}
    assert store.read("silver_orders").count() + store.read("silver_orders_quarantine").count() == o.count()
    assert {"gold_revenue", "gold_customer_rfm", "gold_customers"} <= set(store.tables()) and medallion.weekly_pii_audit(store)["status"] == "PASS"
    assert "<table" in medallion.dq_report_html({"score": 1, "checks": [{"check": "a<b", "passed": True}]})
    ingest.save_metrics_row(store, out["report"]["dq_metrics"], "x")
    assert store.read("dq_metrics").first().dim_completeness > 0 and ingest.save_json(str(tmp_path), "m", {"a": 1}, "s").endswith("m_s.json")


def test_streaming_ingest_is_exactly_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    streaming.produce(src, 7, 10)
    progress = streaming.run_available(spark, src, sink, ck)
    assert len([p for p in progress if p["rows"]]) == 2
    streaming.produce(src, 1, 5)
    streaming.run_available(spark, src, sink, ck)
    rows = spark.read.parquet(sink)
    assert rows.count() == 75 and rows.filter("_event_ts IS NULL").count() == 0 and rows.filter("search_query LIKE '%@%'").count() == 0


def test_stream_windows_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    streaming.produce(src, 3, 20)
    counts = streaming.tumbling_counts(streaming.governed(streaming.read_events(spark, src), False), "_event_ts", ["device_type"], "1 minute", watermark="10 minutes")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streaming.tumbling_counts(streaming.governed(spark.read.schema(streaming.EVENT_SCHEMA).json(src), False), "_event_ts", ["device_type"], "1 minute")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    assert streaming.start_rate_benchmark(spark, 100, 2.0)["rows"] >= 0


def test_logging_and_session(spark, capsys):
    log = logs.setup_logger("t", "INFO")
    logs.set_correlation_id("run-1")
    log.info("hello")
    assert json.loads(capsys.readouterr().err.strip().splitlines()[-1])["correlation_id"] == "run-1"
    assert get_session().sparkContext is spark.sparkContext
