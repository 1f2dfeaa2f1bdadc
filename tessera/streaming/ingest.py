"""Governed streaming ingest of click events, and event-time extensions."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.pii import mask_column
from tessera.operators.ranking import deduplicate

#: Fixed values of the event generator.
EVENT_TYPES = ["page_view", "search", "add_to_cart", "remove_from_cart", "checkout", "purchase", "review", "wishlist"]
PAGES = ["/home", "/search", "/product", "/cart", "/checkout", "/orders", "/profile", "/help"]
DEVICES, CITIES = ["mobile", "desktop", "tablet"], ["Mumbai", "Delhi", "Bengaluru", "Hyderabad", "Chennai", "Kolkata", "Pune", "Jaipur", "Lucknow", "Surat"]
EVENT_SCHEMA = "event_id string, session_id string, user_id string, event_type string, page_url string, device_type string, city string, timestamp string, duration_ms int, referrer string, search_query string"


def click_events(n: int, seed: int = 0, pii_share: float = 0.05) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        pii = rng.random() < pii_share
        query = rng.choice(["shoes", "phone case", "kurta", None])
        out.append({
            "event_id": f"{seed}-{i}", "session_id": f"s{rng.randrange(1000)}", "user_id": f"u{rng.randrange(500)}", "event_type": rng.choice(EVENT_TYPES), "page_url": rng.choice(PAGES),
            "device_type": rng.choice(DEVICES), "city": rng.choice(CITIES), "timestamp": datetime.fromtimestamp(1_700_000_000 + seed * 100 + i, UTC).isoformat().replace("+00:00", "Z"),
            "duration_ms": rng.randrange(50, 30000), "referrer": rng.choice(["google", "direct", "email"]), "search_query": f"order for user{i}@example.com" if pii else query,
        })
    return out


def write_micro_batch(events: list[dict], folder: str) -> str:
    """One JSON-lines file; it appears under its final name only when complete."""
    path = Path(folder) / f"events_{uuid.uuid4().hex}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    hidden = path.with_name(f".{path.name}")
    hidden.write_text("\n".join(json.dumps(e) for e in events))
    hidden.rename(path)
    return str(path)


def produce(folder: str, batches: int, size: int, pause_s: float = 0.0) -> None:
    for k in range(batches):
        write_micro_batch(click_events(size, k), folder)
        time.sleep(pause_s)


def read_events(spark: SparkSession, folder: str, max_files: int = 5) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def governed(events: DataFrame, pii_mask: bool = True, batch_id: str = "stream") -> DataFrame:
    """Audit columns, event time, and masked search queries; works on streams and tables."""
    out = events.withColumns({"_ingested_at": F.current_timestamp(), "_batch_id": F.lit(batch_id), "_event_ts": F.try_to_timestamp("timestamp")})
    return out.withColumn("search_query", mask_column(F.col("search_query"))) if pii_mask else out


def start_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, *, pii_mask: bool = True, trigger: dict | None = None, max_files: int = 5) -> StreamingQuery:
    """Exactly-once file stream into Parquet; ``trigger`` as for writeStream, default 10 s."""
    out = governed(read_events(spark, source, max_files), pii_mask)
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start(sink)


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, **options) -> list[dict]:
    """Ingests all files present and stops; progress per batch."""
    query = start_stream(spark, source, sink, checkpoint, trigger={"availableNow": True}, **options)
    query.awaitTermination()
    return [dict(batch=p["batchId"], rows=p["numInputRows"]) for p in query.recentProgress]


def start_rate_benchmark(spark: SparkSession, rows_per_second: int = 10_000, duration_s: float = 10.0) -> dict:
    """Rows a rate stream delivers to a sink that keeps none, over a given time."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumn("k", F.col("value") % 1000)
    query = rows.writeStream.format("noop").start()
    try:
        query.awaitTermination(duration_s)
        total = sum(p["numInputRows"] for p in query.recentProgress)
    finally:
        query.stop()
    return {"rows": total, "seconds": duration_s, "rows_per_second": total / duration_s}


def upsert_batches(keys: list[str], order_col: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: each batch's last row per key by ``order_col``, with its batch id, so replays can be told."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(deduplicate(batch, keys, order_col), batch_id)

    return run


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 day", watermark: str | None = None, value: str | None = None) -> DataFrame:
    """Extension: event-time windows; on a stream give a watermark so that state is dropped."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    aggs = [F.count("*").alias("events"), *([F.sum(value).alias("total_value")] if value else [])]
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in ("events", "total_value") if c in out.columns])


def session_counts(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Extension: sessions that end after a pause."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("events"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
