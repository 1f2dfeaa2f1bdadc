"""Thresholds, weights and warnings learned from the history of runs.

A history is a DataFrame (label, run_seq, score, and one column per dimension, or a
map ``dims``).  Everything is a window or an aggregation by label, so it answers for
every run and every label at once; the latest run's row is what a single evaluation
needs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 20
SENSITIVITY = 1.5
FLOOR, CEILING = 70.0, 99.0
DEFAULT_THRESHOLD = 85.0
MIN_RUNS = 3
MAX_HISTORY = 200
HISTORY_SCHEMA = "label string, run_seq long, score double, dims map<string,double>, row_count long"


def rolling_thresholds(history: DataFrame, window: int = WINDOW, sensitivity: float = SENSITIVITY) -> DataFrame:
    """Per run: mean, deviation, threshold and trend of the last ``window`` runs up to it.

    Threshold: mean minus ``sensitivity`` deviations, kept within 70 and 99; 85 below
    three runs.  The trend is the least-squares slope.
    """
    last = Window.partitionBy("label").orderBy("run_seq").rowsBetween(-(window - 1), 0)
    out = history.withColumns({
        "runs": F.count("score").over(last),
        "mean_score": F.avg("score").over(last),
        "std_score": F.stddev_pop("score").over(last),
        "slope": F.regr_slope(F.col("score"), F.col("run_seq").cast("double")).over(last),
    })
    enough = F.col("runs") >= MIN_RUNS
    clamped = F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.col("mean_score") - sensitivity * F.col("std_score")))
    status = F.when(~enough, "insufficient_history").when(F.col("slope") > 0.5, "improving").when(F.col("slope") < -0.5, "declining").otherwise("stable")
    return out.withColumns({"threshold": F.when(enough, clamped).otherwise(DEFAULT_THRESHOLD), "status": status})


def early_warnings(history: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per run, against the runs before it: a falling last three and the run's own score.

    critical: decline, score below the mean, slope below -1; warning: decline and
    slope below -0.5; info: score below the mean.
    """
    before = Window.partitionBy("label").orderBy("run_seq").rowsBetween(-window, -1)
    order = Window.partitionBy("label").orderBy("run_seq")
    a, b, c = (F.lag("score", k).over(order) for k in (3, 2, 1))
    out = history.withColumns({
        "prior_runs": F.count("score").over(before),
        "prior_mean": F.avg("score").over(before),
        "prior_slope": F.regr_slope(F.col("score"), F.col("run_seq").cast("double")).over(before),
        "declining": F.coalesce((a > b) & (b > c), F.lit(False)),
    })
    below = F.col("score") < F.col("prior_mean")
    level = (
        F.when(F.col("prior_runs") < MIN_RUNS, "none")
        .when(F.col("declining") & below & (F.col("prior_slope") < -1), "critical")
        .when(F.col("declining") & (F.col("prior_slope") < -0.5), "warning")
        .when(below, "info")
        .otherwise("none")
    )
    return out.withColumn("alert_level", level)


def inverse_mean_weights(history: DataFrame) -> DataFrame:
    """(label, dimension, weight): weights fall with a dimension's mean; none below three runs."""
    long = history.select("label", "run_seq", F.explode("dims").alias("dimension", "value"))
    means = long.groupBy("label", "dimension").agg(F.avg("value").alias("mean"), F.count_distinct("run_seq").alias("runs"))
    means = means.filter(F.col("runs") >= MIN_RUNS).withColumn("inverse", 1 / (F.col("mean") + 1e-6))
    return means.withColumn("weight", F.round(F.col("inverse") / F.sum("inverse").over(Window.partitionBy("label")), 4)).select("label", "dimension", "mean", "weight")


def regression_weights(history: DataFrame, label: str, dimensions: list[str]) -> dict[str, float]:
    """Normalised absolute least-squares coefficients of the dimensions on the score.

    The normal equations are one aggregation over the history; {} below five runs or
    fewer runs than dimensions.
    """
    cols = [F.lit(1.0), *[F.coalesce(F.col("dims")[d], F.lit(0.0)) for d in dimensions], F.col("score")]
    k = len(cols)
    pairs = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    row = history.filter(F.col("label") == label).agg(F.count("*").alias("n"), *pairs).first()
    if row.n < 5 or row.n < len(dimensions):
        return {}
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    coef = np.abs(np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0][1:])
    total = coef.sum()
    return {d: round(float(c / total), 4) for d, c in zip(dimensions, coef, strict=True)} if total > 0 else {}


def record_run(spark: SparkSession, history: DataFrame | None, label: str, score: float, dims: dict[str, float], row_count: int) -> DataFrame:
    """The history with one more run; the last 200 of each label stay."""
    last = history.filter(F.col("label") == label).agg(F.max("run_seq")).first()[0] if history is not None else None
    row = spark.createDataFrame([(label, (last or 0) + 1, float(score), {k: float(v) for k, v in dims.items()}, row_count)], HISTORY_SCHEMA)
    if history is None:
        return row
    newest = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("run_seq")))
    return history.unionByName(row).withColumn("_rn", newest).filter(F.col("_rn") <= MAX_HISTORY).drop("_rn")
