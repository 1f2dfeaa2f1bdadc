"""Synthetic e-commerce tables and poisoned records, as seeded Spark plans.

Values follow from hashes of the row number and the seed, so tables of any size are
made in parallel and are the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES = ["Mumbai", "Delhi", "Bengaluru", "Hyderabad", "Chennai", "Kolkata", "Pune", "Jaipur"]
FIRST, LAST = ["Aarav", "Diya", "Ishaan", "Kavya", "Rohan", "Sneha", "Vikram", "Zoya"], ["Sharma", "Iyer", "Khan", "Patel", "Reddy", "Singh", "Das", "Nair"]
CATEGORIES = ["Electronics", "Fashion", "Home", "Books", "Beauty", "Sports", "Toys", "Grocery"]
PAYMENTS, STATUSES, SEGMENTS = ["UPI", "Card", "COD", "Wallet", "NetBanking"], ["delivered", "shipped", "processing", "cancelled", "returned"], ["premium", "regular", "budget", "inactive"]


def _unit(name: str, seed: int, key: str = "id") -> Column:
    """Uniform in [0, 1), by row and purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(values: Sequence[str], name: str, seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(_unit(name, seed) * len(values)) + 1).cast("int"))


def _int(low: int, high: int, name: str, seed: int) -> Column:
    return (F.lit(low) + F.floor(_unit(name, seed) * (high - low))).cast("long")


def _maybe(value: Column, share: float, name: str, seed: int) -> Column:
    """Null for a share of the rows."""
    return F.when(_unit(name, seed) >= share, value)


def customers(spark: SparkSession, n: int, seed: int = 42, near_duplicates: float = 0.03) -> DataFrame:
    first, last = _pick(FIRST, "first", seed), _pick(LAST, "last", seed)
    email = F.concat(F.lower(first), F.lit("."), F.lower(last), F.col("id"), F.lit("@example.com"))
    out = spark.range(n).select(
        F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("customer_id"), first.alias("first_name"), last.alias("last_name"),
        _maybe(F.when(_unit("bad_email", seed) < 0.02, "not-an-email").otherwise(email), 0.05, "no_email", seed).alias("email"),
        _maybe(F.concat(F.lit("+91 "), _int(6_000_000_000, 9_999_999_999, "phone", seed).cast("string")), 0.05, "no_phone", seed).alias("phone"),
        _maybe(F.concat_ws(" ", *[_int(1000, 9999, f"aadhaar{k}", seed).cast("string") for k in range(3)]), 0.05, "no_aadhaar", seed).alias("aadhaar"),
        _pick(CITIES, "city", seed).alias("city"), _int(100_000, 999_999, "pin", seed).cast("string").alias("pincode"), _pick(SEGMENTS, "segment", seed).alias("customer_segment"),
        F.date_add(F.lit("2020-01-01").cast("date"), _int(0, 1500, "registered", seed).cast("int")).alias("registration_date"),
        (_unit("marketing", seed) < 0.6).alias("consent_marketing"), (_unit("processing", seed) < 0.95).alias("consent_data_processing"), F.col("id").alias("_n"),
    )
    near = out.filter(F.pmod(F.xxhash64(F.lit(seed), F.col("_n")), F.lit(1000)) < int(near_duplicates * 1000))
    near = near.withColumns({"customer_id": F.concat(F.lit("D"), F.substring("customer_id", 2, 10)), "first_name": F.when(F.col("_n") % 2 == 0, F.concat("first_name", F.lit("a"))).otherwise(F.col("first_name"))})
    return out.unionByName(near).drop("_n")


def products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    text = F.when(_unit("pii", seed) < 0.05, F.concat(F.lit("Write to seller"), F.col("id"), F.lit("@shop.example.com"))).otherwise("A fine product")
    return spark.range(n).select(
        F.concat(F.lit("P"), F.col("id")).alias("product_id"), F.concat(_pick(CATEGORIES, "category", seed), F.lit(" item "), F.col("id")).alias("product_name"), _pick(CATEGORIES, "category", seed).alias("category"),
        F.round(_unit("price", seed) * 5000 + 50, 2).alias("price"), text.alias("description"), F.concat(F.lit("S"), _int(0, 500, "seller", seed)).alias("seller_id"),
        F.round(1 + _unit("rating", seed) * 4, 1).alias("rating"), _int(0, 1000, "stock", seed).alias("stock_quantity"),
    )


def orders(spark: SparkSession, n: int, n_customers: int, seed: int = 42, start: str = "2024-01-01", days: int = 365) -> DataFrame:
    value = F.round(_unit("value", seed) * 20000 + 100, 2)
    value = F.when(_unit("negative", seed) < 0.02, -value).when(_unit("outlier", seed) < 0.005, F.round(500_000 + _unit("big", seed) * 1_500_000, 2)).otherwise(value)
    when = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + _int(0, days * 86400, "ts", seed))
    when = F.when(_unit("late", seed) < 0.03, when - F.make_interval(hours=_int(6, 168, "delay", seed).cast("int"))).otherwise(when)
    note = F.when(_unit("pii", seed) < 0.10, F.concat(F.lit("Call "), _int(6_000_000_000, 9_999_999_999, "note", seed))).otherwise("Leave at the door")
    return spark.range(n).select(
        F.concat(F.lit("O"), F.col("id")).alias("order_id"), F.concat(F.lit("C"), F.lpad(_int(0, n_customers, "customer", seed).cast("string"), 10, "0")).alias("customer_id"),
        F.concat(F.lit("P"), _int(0, 1000, "product", seed)).alias("product_id"), _pick(CATEGORIES, "category", seed).alias("product_category"), value.alias("order_value"), _pick(PAYMENTS, "payment", seed).alias("payment_method"),
        _pick(STATUSES, "status", seed).alias("order_status"), when.alias("order_timestamp"), _maybe(_pick(CITIES, "city", seed), 0.01, "no_city", seed).alias("delivery_city"),
        _int(100_000, 999_999, "pin", seed).cast("string").alias("delivery_pincode"), _maybe(note, 0.05, "no_note", seed).alias("delivery_instructions"),
    )


def reviews(spark: SparkSession, n: int, n_customers: int, seed: int = 42) -> DataFrame:
    text = F.when(_unit("pii", seed) < 0.15, F.concat(F.lit("Reach me at user"), F.col("id"), F.lit("@mail.example.com"))).otherwise("Good value")
    return spark.range(n).select(F.concat(F.lit("R"), F.col("id")).alias("review_id"), F.concat(F.lit("C"), F.lpad(_int(0, n_customers, "customer", seed).cast("string"), 10, "0")).alias("customer_id"), F.concat(F.lit("P"), _int(0, 1000, "product", seed)).alias("product_id"), _int(1, 6, "rating", seed).alias("rating"), text.alias("review_text"), (_unit("verified", seed) < 0.8).alias("verified_purchase"))


def order_items(spark: SparkSession, n: int, n_orders: int, seed: int = 42) -> DataFrame:
    price, quantity, discount = F.round(_unit("price", seed) * 3000 + 50, 2), _int(1, 6, "quantity", seed), F.round(_unit("discount", seed) * 0.3, 2)
    total = F.round(price * quantity * (1 - discount), 2)
    return spark.range(n).select(F.concat(F.lit("I"), F.col("id")).alias("item_id"), F.concat(F.lit("O"), _int(0, n_orders, "order", seed)).alias("order_id"), F.concat(F.lit("P"), _int(0, 1000, "product", seed)).alias("product_id"), quantity.alias("quantity"), price.alias("unit_price"), F.when(_unit("negative", seed) < 0.005, -total).otherwise(total).alias("total_price"), discount.alias("discount_pct"))


def inject_issues(orders: DataFrame, key: str = "order_id", seed: int = 7) -> DataFrame:
    """5 % nulls in four columns, 2 % negative values, 3 % repeated rows, 1 % future times."""
    u = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(key)), F.lit(10_000)) / 10_000.0
    out = orders
    for c in ("customer_id", "delivery_city", "delivery_pincode", "payment_method"):
        if c in out.columns:
            out = out.withColumn(c, F.when(u(c) >= 0.05, F.col(c)))
    out = out.withColumn("order_value", F.when(u("negative") < 0.02, -F.abs("order_value")).otherwise(F.col("order_value")))
    out = out.withColumn("order_timestamp", F.when(u("future") < 0.01, F.col("order_timestamp") + F.expr("INTERVAL 400 DAYS")).otherwise(F.col("order_timestamp")))
    return out.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.when(u("copy") < 0.03, 2).otherwise(1)))).drop("_copies")


def generate_all(spark: SparkSession, n_customers: int = 10_000, n_products: int = 10_000, n_orders: int = 100_000, n_reviews: int = 50_000, n_items: int = 100_000, seed: int = 42) -> dict[str, DataFrame]:
    return {
        "customers": customers(spark, n_customers, seed), "products": products(spark, n_products, seed), "orders": orders(spark, n_orders, n_customers, seed),
        "reviews": reviews(spark, n_reviews, n_customers, seed), "order_items": order_items(spark, n_items, n_orders, seed),
    }


# --- stress records -----------------------------------------------------------

POISONS = ("pii_leak", "null_spike", "schema_break", "late_data", "duplicate", "format_corrupt", "value_anomaly")
PROFILES = {
    "mixed": {"pii_leak": 0.05, "null_spike": 0.03, "schema_break": 0.02, "late_data": 0.05, "duplicate": 0.03, "format_corrupt": 0.02, "value_anomaly": 0.03},
    "pii_heavy": {"pii_leak": 0.5},
    "null_burst": {"null_spike": 0.4},
    "schema_chaos": {"schema_break": 0.4},
    "full_chaos": dict.fromkeys(POISONS, 0.1),
}


def poisoned(records: DataFrame, profile: dict[str, float], key: str = "order_id", seed: int = 11, null_columns: Sequence[str] = ("email", "phone", "order_value"), max_delay_hours: int = 72, max_copies: int = 5) -> DataFrame:
    """Records with ``_poison``: of the profile's shares the first that a row falls into wins.

    A broken schema shows as a value of the wrong type in ``order_value`` (then text).
    """
    u = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(key)), F.lit(100_000)) / 100_000.0
    kind, low = F.lit(None).cast("string"), 0.0
    chosen = F.lit(None).cast("string")
    for name in POISONS:
        share = profile.get(name, 0.0)
        if share:
            chosen = F.coalesce(chosen, F.when((u("poison") >= low) & (u("poison") < low + share), name))
            low += share
    out = records.withColumn("_poison", F.coalesce(chosen, kind))
    is_ = lambda name: F.coalesce(F.col("_poison") == name, F.lit(False))
    digits = F.lpad(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10**12)).cast("string"), 12, "1")
    leak = F.element_at(F.array(F.concat(F.lit("Please charge card 4111"), digits), F.concat(F.lit("Aadhaar: "), F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4), F.lit(" "), F.substring(digits, 9, 4)), F.concat(F.lit("Contact me at a"), digits, F.lit("@example.com")), F.concat(F.lit("Account IFSC SBIN0"), F.substring(digits, 1, 6)), F.concat(F.lit("PAN is ABCPE"), F.substring(digits, 1, 4), F.lit("K"))), (F.floor(u("leak") * 5) + 1).cast("int"))
    if "delivery_notes" in out.columns:
        out = out.withColumn("delivery_notes", F.when(is_("pii_leak"), leak).when(is_("format_corrupt"), F.expr("substring(delivery_notes, 1, greatest(1, length(delivery_notes) div 3))")).otherwise(F.col("delivery_notes")))
    if "order_timestamp" in out.columns:
        delay = F.make_interval(hours=(2 + F.floor(u("delay") * (max_delay_hours - 2))).cast("int"))
        out = out.withColumn("order_timestamp", F.when(is_("late_data"), F.col("order_timestamp") - delay).otherwise(F.col("order_timestamp")))
    if "order_value" in out.columns:
        v = F.col("order_value").cast("double")
        odd = F.when(u("anomaly") < 0.5, -F.abs(100 + u("low") * 49_900)).otherwise(5_000_000 + u("high") * 94_999_999)
        out = out.withColumn("order_value", F.when(is_("value_anomaly"), odd).otherwise(v).cast("string"))
        out = out.withColumn("order_value", F.when(is_("schema_break"), "not_a_number").otherwise(F.col("order_value")))
    for c in null_columns:
        if c in out.columns:
            out = out.withColumn(c, F.when(~is_("null_spike"), F.col(c)))
    copies = F.when(is_("duplicate"), (2 + F.floor(u("copies") * (max_copies - 1))).cast("int")).otherwise(1)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def write_records(records: DataFrame, path: str, file_format: str = "json") -> None:
    """JSON lines, CSV with header, or Parquet."""
    if file_format not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown format: {file_format}")
    writer = records.write.mode("overwrite")
    (writer.option("header", True) if file_format == "csv" else writer).format(file_format).save(path)


def save_profiles(folder: str) -> list[str]:
    """The profiles as YAML files that ``load_profile`` reads."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for name, shares in PROFILES.items():
        path = Path(folder) / f"{name}.yaml"
        path.write_text(yaml.safe_dump({"name": name, "poisons": shares}, sort_keys=False))
        out.append(str(path))
    return out


def load_profile(path: str) -> dict[str, float]:
    return {k: float(v) for k, v in yaml.safe_load(Path(path).read_text())["poisons"].items()}


def poison_summary(records: DataFrame) -> DataFrame:
    """Rows per poison and their share of all rows."""
    from pyspark.sql import Window

    out = records.groupBy(F.coalesce("_poison", F.lit("clean")).alias("poison")).agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 2))
