"""The governance engine: one evaluation of a table against its own history."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import adaptive, anomaly, dq, pii


def evaluate(df: DataFrame, label: str, history: DataFrame | None, *, required_columns: Sequence[str], validity_rules: dict[str, str] | None = None, numeric_columns: Sequence[str] | None = None, feedback: DataFrame | None = None, feedback_order: str = "timestamp", consistency_rules: Sequence[dict[str, str]] = (), timestamp_col: str | None = None, as_of: str | None = None, with_forest: bool = True) -> tuple[dict[str, Any], DataFrame]:
    """(report, history with this run).

    Learned weights and the score, anomalies, threshold, early warning and batch
    anomaly come from earlier runs; then the run is recorded.  A score below the
    threshold fails; a warning, a critical alert or an anomalous batch warns.  The
    combined anomaly count is the plain sum of the three detectors.
    """
    spark = df.sparkSession
    past = history.filter(F.col("label") == label) if history is not None else spark.createDataFrame([], adaptive.HISTORY_SCHEMA)
    weights = {r.dimension: r.weight for r in adaptive.inverse_mean_weights(past).collect()}
    metrics = dq.metrics_dict(dq.dq_metrics(df, required_columns, validity_rules, consistency_rules, timestamp_col, as_of, weights=weights or None))
    score, dims, rows = metrics["overall_score"], metrics["dimensions"], metrics["row_count"]
    columns = list(numeric_columns or dq.numeric_columns(df))
    found = {"zscore": anomaly.zscore_flags(df, columns)[1].first().total, "iqr": anomaly.iqr_flags(df, columns)[1].first().total} if columns else {}
    if columns and with_forest:
        scored, info = anomaly.isolation_forest(df, columns)
        found["isolation_forest"] = 0 if info["skipped"] else scored.filter("_is_anomaly_iforest").count()
    before = adaptive.rolling_thresholds(past).orderBy(F.desc("run_seq")).first()
    threshold = before.threshold if before else adaptive.DEFAULT_THRESHOLD
    with_run = adaptive.record_run(spark, history, label, score, dims, rows)
    mine = with_run.filter(F.col("label") == label)
    warning = adaptive.early_warnings(mine).orderBy(F.desc("run_seq")).first().alert_level
    values = past.select(F.explode(F.map_concat("dims", F.create_map(F.lit("score"), "score", F.lit("row_count"), F.col("row_count").cast("double")))).alias("metric", "value"))
    batch = {r.metric: r.z for r in anomaly.batch_anomaly(values, dims | {"score": score, "row_count": rows}).filter("is_anomaly").collect()}
    if score < threshold:
        decision = "FAIL"
    elif warning in ("warning", "critical") or batch:
        decision = "WARN"
    else:
        decision = "PASS"
    report = {
        "label": label, "score": score, "adaptive_threshold": threshold, "decision": decision, "dq_metrics": metrics, "anomalies": found, "combined_anomalies": sum(found.values()),
        "learned_weights": weights, "regression_weights": adaptive.regression_weights(mine, label, list(dims)), "early_warning": warning, "batch_anomaly": batch,
    }
    if feedback is not None:
        report["pii_thresholds"] = {r.entity_type: r.threshold for r in pii.tune_thresholds(feedback).collect()}
        report["pii_drift"] = [r.entity_type for r in pii.pii_drift(feedback, feedback_order).filter("drift").collect()]
    return report, with_run
