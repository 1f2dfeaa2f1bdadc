"""Row and batch anomalies: z-scores, IQR fences, isolation forest, run history."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dq import numeric_columns
from tessera.operators.ranking import exact_percentiles

Z_LIMIT = 3.0
IQR_FACTOR = 1.5
CONTAMINATION = 0.05


def _literals(df: DataFrame, measures: dict[str, Column]) -> dict[str, float | None]:
    """A single aggregated row; its values become literals of the next plan."""
    return df.agg(*[m.alias(k) for k, m in measures.items()]).first().asDict()


def zscore_flags(df: DataFrame, columns: Sequence[str] | None = None, limit: float = Z_LIMIT, strict_types: bool = False) -> tuple[DataFrame, DataFrame]:
    """``_anomaly_z_<column>`` and ``_is_anomaly_zscore``; sample deviation, null is no anomaly.

    The second frame has one row of counts (``total`` and per flag), computed when read.
    """
    columns = list(columns or numeric_columns(df, strict_types))
    stats = _literals(df, {f"{k}_{c}": f(c) for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_samp))}) if columns else {}
    flags = {}
    for c in columns:
        mean, std = stats[f"mean_{c}"], stats[f"std_{c}"]
        std = std if std and not math.isnan(std) else 1.0
        z = F.abs(F.col(c).cast("double") - F.lit(mean)) / F.lit(std)
        flags[f"_anomaly_z_{c}"] = F.coalesce(z > limit, F.lit(False))
    out = df.withColumns(flags) if flags else df
    whole = F.lit(False)
    for f in flags:
        whole = whole | F.col(f)
    out = out.withColumn("_is_anomaly_zscore", whole)
    return out, out.agg(F.count_if("_is_anomaly_zscore").alias("total"), *[F.count_if(f).alias(f) for f in flags])


def iqr_flags(df: DataFrame, columns: Sequence[str] | None = None, factor: float = IQR_FACTOR, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``_anomaly_iqr_<column>`` outside the fences (null stays null) and ``_is_anomaly_iqr``; counts as above."""
    columns = list(columns or numeric_columns(df))
    if exact and columns:
        stats = exact_percentiles(df, {c: F.col(c) for c in columns}, (0.25, 0.75))
    else:
        stats = _literals(df, {c: F.percentile_approx(c, [0.25, 0.75], F.lit(1000)) for c in columns}) if columns else {}
    flags, whole = {}, F.lit(False)
    for c in columns:
        q1, q3 = stats[c] or (None, None)
        width = (q3 - q1) * factor if q1 is not None else None
        low, high = (q1 - width, q3 + width) if width is not None else (None, None)
        flags[f"_anomaly_iqr_{c}"] = (F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))
        whole = whole | F.coalesce(F.col(f"_anomaly_iqr_{c}"), F.lit(False))
    out = (df.withColumns(flags) if flags else df).withColumn("_is_anomaly_iqr", whole)
    return out, out.agg(F.count_if("_is_anomaly_iqr").alias("total"), *[F.count_if(f).alias(f) for f in flags])


class IsolationForest:
    """Random isolation trees as arrays; scored level by level for whole batches."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        depth = max(1, math.ceil(math.log2(max(2, size))))
        nodes = 2 ** (depth + 1) - 1
        self.depth, self.norm = depth, self.average_path(np.array([size]))[0] or 1.0
        self.feature = np.full((self.trees, nodes), -1, np.int32)
        self.cut = np.zeros((self.trees, nodes))
        self.length = np.zeros((self.trees, nodes))
        for t in range(self.trees):
            todo = [(0, 0, rng.choice(len(x), size, replace=False))]
            while todo:
                node, d, rows = todo.pop()
                spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
                usable = np.flatnonzero(spread > 0)
                if d == depth or len(rows) <= 1 or not len(usable):
                    self.length[t, node] = d + self.average_path(np.array([len(rows)]))[0]
                    continue
                f = rng.choice(usable)
                cut = rng.uniform(x[rows, f].min(), x[rows, f].max())
                self.feature[t, node], self.cut[t, node] = f, cut
                left = x[rows, f] < cut
                todo += [(2 * node + 1, d + 1, rows[left]), (2 * node + 2, d + 1, rows[~left])]
        return self

    @staticmethod
    def average_path(n: np.ndarray) -> np.ndarray:
        """Mean depth of an unsuccessful search among n points."""
        n = n.astype(float)
        big = np.maximum(n, 2)
        path = 2 * (np.log(np.maximum(big - 1, 1)) + np.euler_gamma) - 2 * (big - 1) / big
        return np.where(n > 2, path, np.where(n == 2, 1.0, 0.0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus the usual anomaly score: lower is more anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] >= self.cut[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.length[t, node]
        return -np.power(2.0, -total / self.trees / self.norm)


def isolation_forest(df: DataFrame, columns: Sequence[str] | None = None, *, sample_rows: int = 20_000, contamination: float = CONTAMINATION, seed: int = 42) -> tuple[DataFrame, dict]:
    """``_anomaly_score_iforest`` (below 0: anomalous) and ``_is_anomaly_iforest``, scored in place.

    The forest is fitted on at most about ``sample_rows`` rows without nulls, a
    documented bound; all rows are scored, those with nulls get score 0 and no flag.
    """
    columns = list(columns or numeric_columns(df))
    filled = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    n = filled.count()
    zero = {"_anomaly_score_iforest": F.lit(0.0), "_is_anomaly_iforest": F.lit(False)}
    if n < 10 or not columns:
        return df.withColumns(zero), {"skipped": True, "sample_rows": n}
    share = min(1.0, sample_rows / n)
    x = (filled if share >= 1 else filled.sample(share, seed)).limit(2 * sample_rows).toPandas().to_numpy(float)
    if len(x) < 10:
        return df.withColumns(zero), {"skipped": True, "sample_rows": len(x)}
    forest = IsolationForest(seed=seed).fit(x)
    offset = float(np.quantile(forest.score(x), contamination))

    @F.pandas_udf("double")
    def scored(*cols: pd.Series) -> pd.Series:
        m = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in cols])
        good = ~np.isnan(m).any(axis=1)
        out = np.zeros(len(m))
        out[good] = forest.score(m[good]) - offset
        return pd.Series(out)

    out = df.withColumn("_anomaly_score_iforest", scored(*[F.col(c).cast("double") for c in columns]))
    return out.withColumn("_is_anomaly_iforest", F.col("_anomaly_score_iforest") < 0), {"skipped": False, "sample_rows": len(x), "offset": offset}


def batch_anomaly(history: DataFrame, current: dict[str, float], limit: float = Z_LIMIT) -> DataFrame:
    """Per metric: z-score of the current run against earlier runs (label-filtered ``metric``, ``value``).

    Fewer than three runs: no anomaly; population deviation, 0 counts as 1.
    """
    spark = history.sparkSession
    now = spark.createDataFrame([(k, float(v)) for k, v in current.items()], "metric string, current double")
    stats = history.groupBy("metric").agg(F.count("value").alias("runs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    out = now.join(stats, "metric", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    std = F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std"))
    z = F.when(F.col("runs") >= 3, (F.col("current") - F.col("mean")) / std)
    return out.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))
