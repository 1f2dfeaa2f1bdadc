"""Customer and revenue analytics over orders.

Orders have order_id, customer_id, product_category, order_value, order_timestamp.
Every operator is one aggregation; time-relative ones take an explicit date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import global_row_number

GRAINS = {"daily": "day", "weekly": "week", "monthly": "month"}


def aggregate_revenue(orders: DataFrame, granularities: Sequence[str] = ("daily", "weekly", "monthly")) -> DataFrame:
    """Revenue per period and category for several grains in one scan.

    Days are aggregated first wherever a grain allows it; distinct customers need the
    rows, so each row is expanded by the number of grains and combined map-side.
    """
    unknown = set(granularities) - set(GRAINS)
    if unknown:
        raise ValueError(f"unknown granularity: {sorted(unknown)}")
    ts = F.col("order_timestamp").cast("timestamp")
    grains = F.array(*[F.struct(F.lit(g).alias("granularity"), F.date_trunc(GRAINS[g], ts).alias("period")) for g in granularities])
    rows = orders.select(F.explode(grains).alias("g"), "product_category", "order_value", "order_id", "customer_id")
    return rows.groupBy(F.col("g.period").alias("period"), "product_category", F.col("g.granularity").alias("granularity")).agg(
        F.sum("order_value").alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
        F.avg("order_value").alias("avg_order_value"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )


def _per_customer(orders: DataFrame) -> DataFrame:
    day = F.to_date("order_timestamp")
    return orders.groupBy("customer_id").agg(
        F.max(day).alias("last_date"), F.min(day).alias("first_date"), F.count("order_id").alias("n"), F.sum("order_value").alias("total"), F.avg("order_value").alias("mean")
    )


def ntile_of(position: Column, total: Column, buckets: int) -> Column:
    """SQL's ntile from a 1-based position: the first ``total mod buckets`` buckets get one more."""
    small, extra = F.floor(total / buckets), total % buckets
    in_large = position <= extra * (small + 1)
    large = F.floor((position - 1) / (small + 1)) + 1
    return F.when(in_large, large).otherwise(extra + F.floor((position - 1 - extra * (small + 1)) / F.greatest(small, F.lit(1))) + 1).cast("int")


def compute_rfm(orders: DataFrame, reference_date: str, *, distributed: bool = True) -> DataFrame:
    """Recency, frequency, monetary with quintile scores, 1 the best; ties by customer.

    Ranks come from range partitioning, so no task sorts all customers; a global
    window (``distributed=False``) is quicker for tables that fit into one task.
    """
    base = _per_customer(orders).select(
        "customer_id", F.datediff(F.lit(reference_date).cast("date"), "last_date").alias("recency_days"), F.col("n").alias("frequency"), F.col("total").alias("monetary")
    )
    orders_by = {"recency_score": [F.col("recency_days").asc()], "frequency_score": [F.col("frequency").desc()], "monetary_score": [F.col("monetary").desc()]}
    if distributed:
        out = base
        for name, keys in orders_by.items():
            out, total = global_row_number(out, [*keys, F.col("customer_id").asc()], "_rn")
            out = out.withColumn(name, ntile_of(F.col("_rn"), F.lit(total), 5)).drop("_rn")
    else:
        out = base.withColumns({name: F.ntile(5).over(Window.orderBy(*keys, F.col("customer_id").asc())) for name, keys in orders_by.items()})
    return out.withColumn("rfm_segment", F.concat(*[F.col(c).cast("string") for c in orders_by]))


def compute_clv(orders: DataFrame, lifespan_years: float = 3.0) -> DataFrame:
    """Customer lifetime value: average order times yearly frequency times years."""
    tenure = F.datediff("last_date", "first_date")
    yearly = F.when(F.col("tenure") > 0, F.col("n") / (F.col("tenure") / 365.0)).otherwise(F.col("n").cast("double"))
    out = _per_customer(orders).withColumn("tenure", tenure).withColumn("purchase_frequency_yearly", yearly)
    return out.select(
        "customer_id", F.col("mean").alias("avg_order_value"), F.col("n").alias("total_orders"), F.col("tenure").alias("customer_tenure_days"),
        "purchase_frequency_yearly", (F.col("mean") * F.col("purchase_frequency_yearly") * F.lit(lifespan_years)).alias("estimated_clv"),
    )


def compute_churn_features(orders: DataFrame, as_of: str, inactive_days: int = 90) -> DataFrame:
    """Activity features and a flag for customers inactive longer than ``inactive_days``."""
    out = orders.groupBy("customer_id").agg(
        F.max(F.col("order_timestamp").cast("timestamp")).alias("last_order_date"),
        F.count("order_id").alias("order_count"),
        F.sum("order_value").alias("total_spend"),
        F.avg("order_value").alias("avg_spend"),
        F.stddev_samp("order_value").alias("spend_stddev"),
        F.count_distinct("product_category").alias("category_diversity"),
    )
    out = out.withColumn("days_since_last_order", F.datediff(F.lit(as_of).cast("date"), F.to_date("last_order_date")))
    return out.withColumn("is_churned", F.when(F.col("days_since_last_order") > inactive_days, 1).otherwise(0))


def customer_360(orders: DataFrame, customers: DataFrame, low: float = 0.0, high: float = 1_000_000.0) -> DataFrame:
    """Gold customers: valid orders per customer beside the customer's segment."""
    valid = orders.filter(F.col("order_value").between(low, high))
    agg = valid.groupBy("customer_id").agg(F.count("order_id").alias("total_orders"), F.sum("order_value").alias("total_revenue"), F.avg("order_value").alias("avg_order_value"))
    agg = agg.withColumn("clv_proxy", F.col("total_revenue") * 1.2)
    return agg.join(customers.select("customer_id", "customer_segment"), "customer_id", "left")


def daily_volume(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.to_date("order_timestamp").alias("order_date")).agg(
        F.count("*").alias("order_count"), F.avg("order_value").alias("avg_value"), F.sum("order_value").alias("total_value")
    )


def value_counts(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Counts of value combinations, most frequent first, ties by value."""
    out = df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)
    return out.limit(top) if top else out


def top_customers(gold: DataFrame, n: int = 5) -> DataFrame:
    return gold.orderBy(F.desc("total_revenue"), "customer_id").limit(n)


def consent_report(customers: DataFrame, pii_columns: Sequence[str]) -> DataFrame:
    """Consent rates (missing marketing consent counts as no, processing as yes) and PII coverage, one scan."""
    some = F.lit(False)
    for c in pii_columns:
        some = some | F.col(c).isNotNull()
    return customers.agg(
        F.avg(F.coalesce("consent_marketing", F.lit(False)).cast("int")).alias("marketing_rate"),
        F.avg(F.coalesce("consent_data_processing", F.lit(True)).cast("int")).alias("processing_rate"),
        *[F.count(c).alias(f"{c}_filled") for c in pii_columns],
        F.count_if(some).alias("rows_with_pii"),
    )


def duplicate_key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows whose value occurs more than once (all of them), nulls left out."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counted = long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("column").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_rows"))
