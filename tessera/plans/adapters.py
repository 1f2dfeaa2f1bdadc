"""The star tables seen as the engine's entities; faults are derived from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("order_value"), F.col("o_orderdate").alias("order_timestamp"),
        F.col("o_orderpriority").alias("product_category"), F.col("o_orderstatus").alias("order_status"),
    )


def faulty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th order without customer, 19th without value, 23rd negative, 29th twice."""
    o = orders(spark, sf_dir)
    key = F.col("order_id")
    o = o.withColumns({
        "customer_id": F.when(key % 17 != 0, F.col("customer_id")),
        "order_value": F.when(key % 19 == 0, None).when(key % 23 == 0, -F.col("order_value")).otherwise(F.col("order_value")),
        "delivery_pincode": F.when(key % 13 == 0, "12AB").when(key % 11 == 0, None).otherwise(F.lpad((key % 900000).cast("string"), 6, "1")),
        "payment_method": F.when(key % 31 == 0, "Barter").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("UPI", "Card", "COD", "Wallet", "NetBanking")]), (key % 5 + 1).cast("int"))),
    })
    copies = F.when(key % 29 == 0, 2).otherwise(1)
    return o.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("order_timestamp", F.expr("order_timestamp + make_dt_interval(copy - 1)"))


#: The same table for the SQL side.
FAULTY_SQL = """faulty AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN -o_totalprice ELSE o_totalprice END AS order_value,
    o_orderpriority AS product_category, o_orderstatus AS order_status,
    CASE WHEN o_orderkey % 13 = 0 THEN '12AB' WHEN o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o_orderkey % 900000 AS VARCHAR), 6, '1') END AS delivery_pincode,
    CASE WHEN o_orderkey % 31 = 0 THEN 'Barter' ELSE list_extract(['UPI','Card','COD','Wallet','NetBanking'], CAST(o_orderkey % 5 + 1 AS INTEGER)) END AS payment_method,
    copy, o_orderdate + to_days(CAST(copy - 1 AS INTEGER)) AS order_timestamp
  FROM orders, (VALUES (1), (2)) c(copy) WHERE copy = 1 OR o_orderkey % 29 = 0)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with names, contacts and near-duplicates: every 10th once more under a new id."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("customer_segment"), F.col("c_nationkey").alias("n"))
    firsts, lasts = ("Asha", "Ravi", "Meena", "Arjun", "Kiran", "Leela", "Dev"), ("Rao", "Kumar", "Iyer", "Singh", "Das", "Nair", "Patel", "Khan", "Bose", "Gill", "Jain")
    pick = lambda values, m: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % m + 1).cast("int"))
    base = c.select(
        F.col("k").alias("customer_id"), pick(firsts, 7).alias("first_name"), pick(lasts, 11).alias("last_name"),
        F.when(F.col("k") % 20 != 0, F.concat(F.lit("user"), F.col("k").cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(F.col("k") % 25 != 0, F.concat(F.lit("+91 "), (F.lit(6000000000) + F.col("k")).cast("string"))).alias("phone"),
        F.concat(F.lit("City"), F.col("n").cast("string")).alias("city"), F.lpad((F.col("k") % 900000).cast("string"), 6, "4").alias("pincode"), "customer_segment",
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("k") % 1000).cast("int")).alias("registration_date"), (F.col("k") % 3 == 0).alias("consent_marketing"),
        (F.col("k") % 4 != 0).alias("consent_data_processing"),
    )
    near = base.filter("customer_id % 10 = 0").withColumns({
        "customer_id": F.col("customer_id") + 1_000_000, "first_name": F.concat("first_name", F.lit("a")), "registration_date": F.date_add("registration_date", 30),
        "consent_marketing": F.col("customer_id") % 6 == 0, "email": F.upper("email"),
    })
    return base.unionByName(near)


PEOPLE_SQL = """base AS (
  SELECT c_custkey AS customer_id, list_extract(['Asha','Ravi','Meena','Arjun','Kiran','Leela','Dev'], CAST(c_custkey % 7 + 1 AS INTEGER)) AS first_name,
    list_extract(['Rao','Kumar','Iyer','Singh','Das','Nair','Patel','Khan','Bose','Gill','Jain'], CAST(c_custkey % 11 + 1 AS INTEGER)) AS last_name,
    CASE WHEN c_custkey % 20 <> 0 THEN 'user' || c_custkey || '@example.com' END AS email,
    CASE WHEN c_custkey % 25 <> 0 THEN '+91 ' || (6000000000 + c_custkey) END AS phone, 'City' || c_nationkey AS city, lpad(CAST(c_custkey % 900000 AS VARCHAR), 6, '4') AS pincode,
    c_mktsegment AS customer_segment, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS registration_date, c_custkey % 3 = 0 AS consent_marketing, c_custkey % 4 <> 0 AS consent_data_processing
  FROM customer),
people AS (
  SELECT * FROM base UNION ALL
  SELECT customer_id + 1000000, first_name || 'a', last_name, upper(email), phone, city, pincode, customer_segment, registration_date + 30, customer_id % 6 = 0, consent_data_processing FROM base WHERE customer_id % 10 = 0)"""


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily runs from the events: the share of events that are no errors, in percent, and two dimensions."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    out = e.groupBy(day.cast("long").alias("run_seq")).agg(
        F.round(F.count_if(F.col("event_type") != "error") / F.count("*") * 100, 4).alias("score"), F.round(F.avg("value"), 4).alias("a"), F.round(F.count_if(F.col("event_type") == "view") / F.count("*") * 100, 4).alias("b"), F.count("*").alias("row_count")
    )
    return out.select(F.lit("events").alias("label"), "run_seq", "score", F.create_map(F.lit("completeness"), "a", F.lit("validity"), "b").alias("dims"), "row_count")


HISTORY_SQL = """history AS (
  SELECT 'events' AS label, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS run_seq,
    round(count(*) FILTER (event_type <> 'error') / count(*) * 100, 4) AS score, round(avg(value), 4) AS a, round(count(*) FILTER (event_type = 'view') / count(*) * 100, 4) AS b, count(*) AS row_count
  FROM events GROUP BY 2)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed detections: labels as truth, a score from the document's id."""
    x = table(spark, sf_dir, "labels")
    score = F.round(F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0, 3)
    kind = F.element_at(F.array(F.lit("EMAIL"), F.lit("PHONE_NUMBER"), F.lit("AADHAAR")), (F.col("doc_id") % 3 + 1).cast("int"))
    return x.select(kind.alias("entity_type"), score.alias("score"), (score >= 0.6).alias("predicted_pii"), ((F.col("toxic") == 1) | (score > 0.7)).alias("actual_pii"), F.col("doc_id").alias("seq"))


FEEDBACK_SQL = """fb AS (
  SELECT list_extract(['EMAIL','PHONE_NUMBER','AADHAAR'], CAST(doc_id % 3 + 1 AS INTEGER)) AS entity_type, round(((doc_id * 7919) % 1000) / 1000.0, 3) AS score,
    round(((doc_id * 7919) % 1000) / 1000.0, 3) >= 0.6 AS predicted, (toxic = 1 OR round(((doc_id * 7919) % 1000) / 1000.0, 3) > 0.7) AS actual, doc_id AS seq FROM labels)"""
