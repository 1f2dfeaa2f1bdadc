"""The batch pipeline over the layers: bronze, silver, gate, gold, audit."""

from __future__ import annotations

import html
import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import checks, entity, gold, pii, ranking
from tessera.plans.engine import evaluate
from tessera.sources import ingest
from tessera.sources.store import SnapshotStore

#: Masking of order columns by strategy.
MASKS = {"delivery_instructions": "redact", "customer_review": "redact"}
WHOLE_MASKS = {"delivery_pincode": "tokenize"}


def bronze_to_silver(orders: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(silver, quarantine) of orders: latest per id, keys filled, values in range, masked.

    Rows without an id go to quarantine one by one, before the others are deduplicated.
    """
    orders, keyless = checks.split(orders, [checks.not_null("order_id")])
    deduped = ranking.deduplicate(orders, ["order_id"], "order_timestamp", tie_breakers=[c for c in ("order_value", "customer_id") if c in orders.columns])
    deduped = deduped.withColumn("order_value", F.expr("try_cast(order_value AS double)"))
    valid, bad = checks.split(deduped, [checks.not_null("order_id"), checks.not_null("customer_id"), checks.between("order_value", 0.0, 1_000_000.0)])
    for column, strategy in MASKS.items():
        valid = pii.mask_pii_columns(valid, [column], strategy)
    whole = {c: pii.mask_whole(F.col(c), s) for c, s in WHOLE_MASKS.items() if c in valid.columns}
    valid = valid.withColumns(whole) if whole else valid
    bad = bad.unionByName(keyless.withColumn("order_value", F.expr("try_cast(order_value AS double)")))
    return ingest.silver_metadata(valid, run_id), bad


def silver_to_gold(store: SnapshotStore, orders: DataFrame, as_of: str) -> dict[str, int]:
    frames = {
        "revenue": (gold.aggregate_revenue(orders), ["granularity"]),
        "customer_rfm": (gold.compute_rfm(orders, as_of), []),
        "customer_clv": (gold.compute_clv(orders), []),
        "churn_features": (gold.compute_churn_features(orders, as_of), []),
    }
    return {name: ingest.write_gold(store, df, f"gold_{name}", part) for name, (df, part) in frames.items()}


def run(store: SnapshotStore, orders: DataFrame, customers: DataFrame | None, run_id: str, as_of: str, history: DataFrame | None = None) -> dict[str, Any]:
    """One batch through all layers; timings per step, a failed gate raises."""
    times: dict[str, float] = {}
    began = time.time()

    def lap(name: str) -> None:
        nonlocal began
        times[name], began = time.time() - began, time.time()

    bronze = ingest.write_bronze(store, orders, "bronze_orders", batch_id=run_id)
    lap("bronze")
    if not bronze["written"]:
        return {"run_id": run_id, "bronze": bronze, "decision": "DRIFT", "seconds": times}
    silver, bad = bronze_to_silver(store.read("bronze_orders"), run_id)
    ingest.write_silver(store, silver, "silver_orders")
    ingest.write_quarantine(store, bad, "silver_orders")
    lap("silver")
    clean = store.read("silver_orders")
    report, history = evaluate(clean, "silver_orders", history, required_columns=["order_id", "customer_id", "order_value"], numeric_columns=["order_value"])
    lap("gate")
    if report["decision"] == "FAIL":
        raise RuntimeError(f"quality gate failed: {report['score']} < {report['adaptive_threshold']}")
    silver_to_gold(store, clean, as_of)
    if customers is not None:
        resolved = entity.exact_match_dedup(customers, ["email", "phone"])
        ingest.write_gold(store, entity.hash_identifiers(entity.golden_records(resolved, "registration_date")), "gold_customers")
    lap("gold")
    audit = pii.residual_audit({"silver_orders": clean.select([c for c in clean.columns if not c.startswith("_")])})
    verdict = pii.audit_verdict(audit) if audit is not None else {"status": "PASS"}
    lap("pii_audit")
    return {"run_id": run_id, "report": report, "decision": report["decision"], "pii_audit": verdict, "seconds": times, "history": history}


def weekly_pii_audit(store: SnapshotStore) -> dict[str, Any]:
    tables = {t: store.read(t) for t in store.tables() if t.startswith("silver_") and not t.endswith("quarantine")}
    audit = pii.residual_audit({n: t.select([c for c in t.columns if not c.startswith("_")]) for n, t in tables.items()})
    return pii.audit_verdict(audit) if audit is not None else {"tables_with_pii": 0, "occurrences": 0, "status": "PASS"}


def dq_report_html(report: dict[str, Any], title: str = "Data quality") -> str:
    """A plain HTML page of a suite's or contract's results."""
    results = report.get("results") or report.get("checks") or []
    columns = list(dict.fromkeys(k for r in results for k in r))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in results)
    score = report.get("score", report.get("dq_score"))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>Score: {score}</p><table border='1'><tr>{head}</tr>{rows}</table></body></html>"
