"""Scans and layer sinks: readers, incremental loads, schema drift, bronze, silver, gold, quarantine."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import SnapshotStore


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, *, header: bool = True, infer_schema: bool = True, delimiter: str = ",", multiline: bool = False) -> DataFrame:
    reader = spark.read.options(header=header, sep=delimiter, multiLine=multiline, inferSchema=infer_schema and schema is None)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, *, multiline: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


class Watermarks:
    """High-water marks per table, in one JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def save(self, table: str, value: Any) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.load() | {table: str(value)}))


def newer_than(df: DataFrame, timestamp_col: str, watermark: str | None) -> DataFrame:
    """Rows strictly after the mark; the filter reaches the scan."""
    if watermark is None:
        return df
    return df.filter(F.col(timestamp_col) > F.lit(watermark).cast(df.schema[timestamp_col].dataType))


def load_incremental(spark: SparkSession, path: str, table: str, timestamp_col: str, marks: Watermarks, file_format: str = "parquet") -> tuple[DataFrame, Callable[[], None]]:
    """New rows, and a function that moves the mark to the latest event ingested.

    The mark follows the event column, so events that arrive late but after the mark
    are not skipped; call it once the rows are safely written.
    """
    readers = {"parquet": read_parquet, "csv": read_csv, "json": read_json}
    new = newer_than(readers[file_format](spark, path), timestamp_col, marks.load().get(table))

    def advance() -> None:
        top = new.agg(F.max(F.col(timestamp_col).cast("string"))).first()[0]
        if top is not None:
            marks.save(table, top)

    return new, advance


# --- schemas ------------------------------------------------------------------


def schema_diff(old: T.StructType, new: T.StructType) -> dict[str, Any]:
    """Columns added and removed, type and nullability changes, all sorted."""
    a, b = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    both = sorted(set(a) & set(b))
    types = [{"column": c, "from": a[c].dataType.simpleString(), "to": b[c].dataType.simpleString()} for c in both if a[c].dataType != b[c].dataType]
    nulls = [{"column": c, "from": a[c].nullable, "to": b[c].nullable} for c in both if a[c].nullable != b[c].nullable]
    added, removed = sorted(set(b) - set(a)), sorted(set(a) - set(b))
    return {"has_drift": bool(added or removed or types), "added": added, "removed": removed, "type_changes": types, "nullable_changes": nulls}


class SchemaRegistry:
    """Schemas by table with their history, as JSON that Spark itself reads back."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _file(self, table: str) -> Path:
        return self.path / f"{table}.json"

    def register_schema(self, table: str, schema: T.StructType) -> int:
        entries = json.loads(self._file(table).read_text()) if self._file(table).exists() else []
        if not entries or entries[-1] != schema.jsonValue():
            entries.append(schema.jsonValue())
            self.path.mkdir(parents=True, exist_ok=True)
            self._file(table).write_text(json.dumps(entries))
        return len(entries)

    def get_schema(self, table: str, version: int | None = None) -> T.StructType | None:
        if not self._file(table).exists():
            return None
        entries = json.loads(self._file(table).read_text())
        return T.StructType.fromJson(entries[-1 if version is None else version - 1])

    def compare_schemas(self, table: str, schema: T.StructType) -> dict[str, Any]:
        old = self.get_schema(table)
        return schema_diff(old, schema) if old else schema_diff(schema, schema)

    def list_schemas(self) -> list[str]:
        return sorted(p.stem for p in self.path.glob("*.json")) if self.path.exists() else []


def detect_schema_drift(df: DataFrame, store: SnapshotStore, table: str, ignore: Sequence[str] = ()) -> dict[str, Any]:
    """Against the stored table; no table, no drift.  Audit columns are left out."""
    if not store.exists(table):
        return schema_diff(df.schema, df.schema)
    old = T.StructType([f for f in store.read(table).schema.fields if not f.name.startswith("_") and f.name not in ignore])
    new = T.StructType([f for f in df.schema.fields if not f.name.startswith("_") and f.name not in ignore])
    return schema_diff(old, new)


def detect_reference_drift(df: DataFrame, registry: SchemaRegistry, table: str) -> dict[str, Any]:
    """Against a saved reference; the first call saves it."""
    if registry.get_schema(table) is None:
        registry.register_schema(table, df.schema)
    return registry.compare_schemas(table, df.schema)


#: Layer schemas.
_STRINGS = ["customer_id", "product_category", "delivery_instructions", "customer_review", "delivery_city", "delivery_pincode", "payment_method"]
BRONZE_SCHEMA = T.StructType([T.StructField("order_id", T.StringType(), False), *[T.StructField(c, T.StringType()) for c in _STRINGS[:2]], T.StructField("order_value", T.StringType()), *[T.StructField(c, T.StringType()) for c in _STRINGS[2:4]], T.StructField("order_timestamp", T.TimestampType()), *[T.StructField(c, T.StringType()) for c in _STRINGS[4:]]])
SILVER_SCHEMA = T.StructType([T.StructField("order_id", T.StringType(), False), T.StructField("customer_id", T.StringType(), False), T.StructField("product_category", T.StringType()), T.StructField("order_value", T.DoubleType()), T.StructField("delivery_instructions_masked", T.StringType()), T.StructField("customer_review_masked", T.StringType()), T.StructField("order_timestamp", T.TimestampType()), *[T.StructField(c, T.StringType()) for c in _STRINGS[4:]]])
GOLD_CUSTOMER_SCHEMA = T.StructType([T.StructField("customer_id", T.StringType(), False), T.StructField("total_orders", T.LongType()), T.StructField("total_revenue", T.DoubleType()), T.StructField("avg_order_value", T.DoubleType()), T.StructField("clv_proxy", T.DoubleType()), T.StructField("customer_segment", T.StringType())])


def get_schema(layer: str) -> T.StructType:
    layers = {"bronze": BRONZE_SCHEMA, "silver": SILVER_SCHEMA, "gold": GOLD_CUSTOMER_SCHEMA}
    if layer.lower() not in layers:
        raise ValueError(f"unknown layer {layer!r}; one of {sorted(layers)}")
    return layers[layer.lower()]


# --- sinks --------------------------------------------------------------------


def write_bronze(store: SnapshotStore, df: DataFrame, table: str, *, batch_id: str, partition_cols: Sequence[str] = (), enforce_drift_check: bool = True, quarantine_on_drift: bool = True, alert: Callable[[str, dict], None] | None = None, source_file: str | None = None) -> dict[str, Any]:
    """Appends with audit columns; a batch whose types changed goes to quarantine only."""
    drift = detect_schema_drift(df, store, table) if enforce_drift_check else schema_diff(df.schema, df.schema)
    if drift["has_drift"] and alert:
        alert(table, drift)
    if drift["type_changes"] and quarantine_on_drift:
        store.append(df.withColumn("_drift_detail", F.lit(json.dumps(drift))), f"{table}_drift_quarantine")
        return {"written": False, "drift": drift}
    source = F.lit(source_file) if source_file is not None else F.lit(None).cast("string")
    audit = {"_ingested_at": F.current_timestamp(), "_source_file": source, "_batch_id": F.lit(batch_id), "_has_drift": F.lit(drift["has_drift"])}
    version = store.append(df.withColumns(audit), table, partition_cols)
    return {"written": True, "version": version, "drift": drift}


def with_source_file(df: DataFrame) -> DataFrame:
    """File of each row of a file scan."""
    return df.withColumn("_source_file", F.col("_metadata.file_path"))


def silver_metadata(df: DataFrame, run_id: str, version: str = "1.0", processed_by: str = "tessera") -> DataFrame:
    return df.withColumns({
        "_silver_processed_at": F.current_timestamp(), "_dq_validated": F.lit(True), "_pii_masked": F.lit(True), "_pipeline_run_id": F.lit(run_id), "_processed_by": F.lit(processed_by),
        "_transformation_version": F.lit(version), "_right_to_erasure": F.lit(False), "_consent_timestamp": F.current_timestamp(),
    })


def write_silver(store: SnapshotStore, df: DataFrame, table: str, partition_cols: Sequence[str] = ()) -> int:
    return store.overwrite(df, table, partition_cols)


def write_gold(store: SnapshotStore, df: DataFrame, table: str, partition_cols: Sequence[str] = ()) -> int:
    return store.overwrite(df.withColumn("_gold_processed_at", F.current_timestamp()), table, partition_cols)


def write_quarantine(store: SnapshotStore, df: DataFrame, table: str) -> int | None:
    """Appends, unless there is nothing to append."""
    if df.isEmpty():
        return None
    return store.append(df.withColumn("_quarantined_at", F.current_timestamp()), f"{table}_quarantine")


def save_json(path: str, label: str, data: dict[str, Any], stamp: str) -> str:
    file = Path(path) / f"{label}_{stamp}.json"
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(data, default=str, indent=2))
    return str(file)


def save_metrics_row(store: SnapshotStore, metrics: dict[str, Any], label: str, table: str = "dq_metrics") -> int:
    row = {"label": label, "overall_score": float(metrics["overall_score"]), "row_count": int(metrics["row_count"])} | {f"dim_{d}": float(s) for d, s in metrics["dimensions"].items()}
    return store.append(store.spark.createDataFrame([row]), table)
