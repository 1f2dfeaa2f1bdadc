"""Data-quality dimensions and one-pass table profiles.

All measures of a call are compiled into one aggregation.  The engine's results are
small rows; per-column top values use one long form instead of a job per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import ranking

DIMENSIONS = ("completeness", "uniqueness", "validity", "timeliness", "consistency")


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(0.0)


def distinct_with_null(column: str) -> Column:
    """Distinct values with null as one of them."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def completeness(columns: Sequence[str]) -> dict[str, Column]:
    return {c: _pct(F.count(c), F.count("*")) for c in columns}


def uniqueness(columns: Sequence[str]) -> dict[str, Column]:
    return {c: _pct(distinct_with_null(c), F.count("*")) for c in columns}


def validity(rules: dict[str, str]) -> dict[str, Column]:
    return {c: _pct(F.count_if(F.coalesce(F.col(c).cast("string").rlike(r), F.lit(False))), F.count("*")) for c, r in rules.items()}


def timeliness(column: str, as_of: Column, sla_hours: float = 24) -> dict[str, Column]:
    """Share of rows within the SLA of ``as_of`` (null is late) and the mean latency in hours."""
    hours = (as_of.cast("timestamp").cast("double") - F.col(column).cast("timestamp").cast("double")) / 3600.0
    return {"within_sla": _pct(F.count_if(F.coalesce(hours <= sla_hours, F.lit(False))), F.count("*")), "avg_latency_hours": F.round(F.avg(hours), 2)}


def consistency(df: DataFrame, rules: Sequence[dict[str, str]]) -> dict[str, Column]:
    """Share of rows meeting each rule; a rule that cannot be analysed scores 0."""
    out = {}
    for r in rules:
        try:
            df.select(F.expr(r["condition"]).cast("boolean"))
            out[r["name"]] = _pct(F.count_if(F.coalesce(F.expr(r["condition"]), F.lit(False))), F.count("*"))
        except AnalysisException:
            out[r["name"]] = F.lit(0.0)
    return out


def long_measures(df: DataFrame, measures: dict[str, Column], key: str = "column", value: str = "score") -> DataFrame:
    """One row per measure from a single aggregation."""
    names = list(measures)
    wide = df.agg(*[measures[n].cast("double").alias(f"m{i}") for i, n in enumerate(names)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(f"m{i}").alias(value)) for i, n in enumerate(names)])).alias("x")).select("x.*")


def dq_metrics(df: DataFrame, required_columns: Sequence[str], validity_rules: dict[str, str] | None = None, consistency_rules: Sequence[dict[str, str]] = (), timestamp_col: str | None = None, as_of: str | None = None, sla_hours: float = 24, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: a score per dimension and the weighted overall score.

    A dimension is the mean over its columns or rules, 100 where there are none;
    weights default to equal, and a given mapping counts dimensions it lacks as 0.
    """
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    groups = {
        "completeness": completeness(required_columns),
        "uniqueness": uniqueness(required_columns),
        "validity": validity(validity_rules or {}),
        "timeliness": {"t": timeliness(timestamp_col, now, sla_hours)["within_sla"]} if timestamp_col else {},
        "consistency": consistency(df, consistency_rules),
    }
    flat = [m.cast("double").alias(f"{d}{i}") for d, g in groups.items() for i, m in enumerate(g.values())]
    wide = df.agg(F.count("*").alias("row_count"), *flat)
    means = {}
    for d, g in groups.items():
        parts = [F.col(f"{d}{i}") for i in range(len(g))]
        means[d] = F.round(sum(parts[1:], parts[0]) / len(parts), 2) if parts else F.lit(100.0)
    share = weights if weights else dict.fromkeys(DIMENSIONS, 1 / len(DIMENSIONS))
    overall = F.round(sum((F.col(d) * share.get(d, 0.0) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0]) * share.get(DIMENSIONS[0], 0.0)), 2)
    return wide.select("row_count", *[means[d].alias(d) for d in DIMENSIONS]).withColumn("overall_score", overall)


# --- profiles -----------------------------------------------------------------

#: The profiler's loose PII patterns.
PROFILE_PII = {"indian_phone": r"(\+91[\-\s]?)?[6-9]\d{9}", "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "aadhaar": r"\d{4}\s\d{4}\s\d{4}", "pan_card": r"[A-Z]{5}\d{4}[A-Z]"}
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _kind(df: DataFrame, types: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def numeric_columns(df: DataFrame, strict: bool = False) -> list[str]:
    """Numeric columns; ``strict`` keeps to integers and doubles."""
    return _kind(df, (T.IntegerType, T.DoubleType) if strict else T.NumericType)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct_count) with null as a value: values are grouped in one long form, map-side first."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.xxhash64(F.lit(1), F.col(f"`{c}`").cast("string")).alias("a"), F.xxhash64(F.lit(2), F.col(f"`{c}`").cast("string")).alias("b"), F.col(f"`{c}`").isNull().alias("none")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*").distinct().groupBy("column").agg(F.count("*").alias("distinct_count"))


def _finite(column: str) -> Column:
    """A numeric column as doubles without NaN and infinities."""
    d = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def profile_columns(df: DataFrame, *, exact_percentiles: bool = False, pii: bool = True, approximate_distinct: bool = False) -> DataFrame:
    """One row per column: nulls, distinct values, numeric and length statistics, PII row counts.

    One aggregation over one scan, one more over values in long form for exact
    distinct counts (128-bit hashes of them), and one for exact percentiles, which are found at once.  NaN and infinities count as missing in
    numeric statistics.
    """
    numbers, strings = set(numeric_columns(df)), set(_kind(df, T.StringType))
    exact = {}
    if exact_percentiles and numbers:
        exact = ranking.exact_percentiles(df, {c: _finite(c) for c in df.columns if c in numbers}, PERCENTILES)
    aggs: list[Column] = [F.count("*").alias("rows")]
    items = []
    for i, c in enumerate(df.columns):
        q = f"`{c}`"
        aggs.append((F.count("*") - F.count(q)).alias(f"nulls{i}"))
        if approximate_distinct:
            aggs.append((F.approx_count_distinct(q, 0.01) + F.coalesce(F.max(F.col(q).isNull().cast("int")), F.lit(0))).alias(f"distinct{i}"))
        stats = {n: F.lit(None).cast("double") for n in ("min", "max", "mean", "stddev", "sum", "variance", "skewness", "kurtosis", "min_length", "max_length", "avg_length")}
        quantiles, found = F.lit(None).cast("array<double>"), F.lit(None).cast("map<string,bigint>")
        if c in numbers:
            x = _finite(c)
            named = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "stddev": F.stddev(x), "sum": F.sum(x), "variance": F.variance(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x)}
            aggs += [F.round(v, 6).alias(f"{n}{i}") for n, v in named.items()]
            stats |= {n: F.col(f"{n}{i}") for n in named}
            if not exact_percentiles:
                aggs.append(F.percentile_approx(x, list(PERCENTILES), F.lit(100)).alias(f"quantiles{i}"))
                quantiles = F.transform(f"quantiles{i}", lambda v: F.round(v.cast("double"), 4))
            elif exact[c]:
                quantiles = F.array(*[F.round(F.lit(v), 4) for v in exact[c]])
        if c in strings:
            size = F.length(q)
            named = {"min_length": F.min(size), "max_length": F.max(size), "avg_length": F.round(F.avg(size), 2)}
            aggs += [v.cast("double").alias(f"{n}{i}") for n, v in named.items()]
            stats |= {n: F.col(f"{n}{i}") for n in named}
            if pii:
                aggs += [F.count_if(F.coalesce(F.col(q).rlike(r), F.lit(False))).alias(f"{k}{i}") for k, r in PROFILE_PII.items()]
                found = F.map_filter(F.create_map(*[y for k in PROFILE_PII for y in (F.lit(k), F.col(f"{k}{i}"))]), lambda _, n: n > 0)
        items.append(F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col("rows").alias("rows"), F.col(f"nulls{i}").alias("null_count"),
            F.when(F.col("rows") > 0, F.round(F.col(f"nulls{i}") / F.col("rows") * 100, 4)).otherwise(0.0).alias("null_pct"), (F.col(f"distinct{i}") if approximate_distinct else F.lit(None).cast("long")).alias("distinct_count"),
            *[v.cast("double").alias(n) for n, v in stats.items()], quantiles.alias("percentiles"), found.alias("pii"),
        ))
    out = df.agg(*aggs).select(F.explode(F.array(*items)).alias("x")).select("x.*")
    if approximate_distinct:
        return out
    counts = distinct_counts(df, df.columns).withColumnRenamed("distinct_count", "_exact")
    return out.join(counts, "column", "left").withColumn("distinct_count", F.coalesce("_exact", F.lit(0))).drop("_exact")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 20) -> DataFrame:
    """(column, value, n, pct, rank): the most frequent filled values of each column, ties by value.

    One long form for all columns, counted map-side; only counted values are ranked.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counted = df.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column"))
    counted = counted.withColumn("pct", F.round(F.col("n") / total * 100, 4)).filter("value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def light_profile(df: DataFrame) -> DataFrame:
    """Nulls, distinct values and mean, stddev, min, max of numeric columns."""
    return profile_columns(df, pii=False).select("column", "type", "rows", "null_count", "distinct_count", "mean", "stddev", "min", "max")


def chart_frames(df: DataFrame, max_columns: int = 5, top: int = 10) -> dict[str, DataFrame]:
    """Data behind the profile's charts; nothing is drawn."""
    p = profile_columns(df)
    few = [r["column"] for r in p.filter("type = 'string'").orderBy("distinct_count", "column").limit(max_columns).collect()]
    return {
        "null_percentages": p.select("column", "null_pct").orderBy(F.desc("null_pct"), "column"),
        "distinct_counts": p.select("column", "distinct_count"),
        "numeric_boxes": p.filter("percentiles IS NOT NULL").select("column", "min", F.col("percentiles")[2].alias("q1"), F.col("percentiles")[3].alias("median"), F.col("percentiles")[4].alias("q3"), "max"),
        "pii_exposure": p.filter("pii IS NOT NULL").select("column", F.explode("pii").alias("pii_type", "rows_with_pii")),
        **({"top_values": top_values(df, few, top)} if few else {}),
    }


def metrics_dict(metrics: DataFrame) -> dict[str, Any]:
    row = metrics.first().asDict()
    return {"overall_score": row["overall_score"], "row_count": row["row_count"], "dimensions": {d: row[d] for d in DIMENSIONS}}
