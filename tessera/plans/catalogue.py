"""Queries over the star tables, one per operator, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import adaptive, anomaly, checks, dq, entity, gold, mesh, pii, ranking, roi, scd
from tessera.plans import adapters as A
from tessera.sources import contracts, generators, ingest
from tessera.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str | None] = {}
AS_OF = "2001-12-31"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 2, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def steady(df: DataFrame, *columns: str) -> DataFrame:
    """To thousandths by a cut that means of prices do not fall on, so that engines agree."""
    return df.withColumns({c: F.floor(F.col(c) * 1000 + 0.3712) / 1000.0 for c in columns})


def st(expr: str) -> str:
    return f"floor(({expr}) * 1000 + 0.3712) / 1000.0"


# --- gold ---------------------------------------------------------------------


@query(f"""SELECT CAST(period AS DATE) AS period, product_category, granularity, round(sum(v), 2) AS total_revenue, count(*) AS total_orders, {st('avg(v)')} AS avg_order_value, count(DISTINCT c) AS unique_customers FROM (
  SELECT date_trunc('day', o_orderdate) AS period, 'daily' AS granularity, o_orderpriority AS product_category, o_totalprice AS v, o_custkey AS c FROM orders UNION ALL
  SELECT date_trunc('week', o_orderdate), 'weekly', o_orderpriority, o_totalprice, o_custkey FROM orders UNION ALL
  SELECT date_trunc('month', o_orderdate), 'monthly', o_orderpriority, o_totalprice, o_custkey FROM orders) GROUP BY ALL""")
def revenue_multi_grain(spark, sf):
    out = gold.aggregate_revenue(A.orders(spark, sf)).withColumn("period", F.to_date("period"))
    return steady(rounded(out, 2, "total_revenue"), "avg_order_value")


RFM_SQL = f"""WITH b AS (SELECT o_custkey AS customer_id, CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '{AS_OF}') AS INTEGER) AS recency_days, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
s AS (SELECT *, CAST(ntile(5) OVER (ORDER BY recency_days, customer_id) AS INTEGER) AS recency_score, CAST(ntile(5) OVER (ORDER BY frequency DESC, customer_id) AS INTEGER) AS frequency_score, CAST(ntile(5) OVER (ORDER BY monetary DESC, customer_id) AS INTEGER) AS monetary_score FROM b)
SELECT customer_id, recency_days, frequency, round(monetary, 2) AS monetary, recency_score, frequency_score, monetary_score, recency_score || '' || frequency_score || '' || monetary_score AS rfm_segment FROM s"""


@query(RFM_SQL)
def rfm(spark, sf):
    return rounded(gold.compute_rfm(A.orders(spark, sf), AS_OF), 2, "monetary")


@query(RFM_SQL)
def rfm_one_window(spark, sf):
    return rounded(gold.compute_rfm(A.orders(spark, sf), AS_OF, distributed=False), 2, "monetary")


@query(f"""WITH b AS (SELECT o_custkey AS customer_id, avg(o_totalprice) AS m, count(*) AS n, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS t FROM orders GROUP BY 1)
SELECT customer_id, {st('m')} AS avg_order_value, n AS total_orders, CAST(t AS INTEGER) AS customer_tenure_days, round(CASE WHEN t > 0 THEN n / (t / 365.0) ELSE n END, 4) AS purchase_frequency_yearly, {st('m * CASE WHEN t > 0 THEN n / (t / 365.0) ELSE n END * 3')} AS estimated_clv FROM b""")
def clv(spark, sf):
    return steady(rounded(gold.compute_clv(A.orders(spark, sf)), 4, "purchase_frequency_yearly"), "avg_order_value", "estimated_clv")


@query(f"""SELECT o_custkey AS customer_id, CAST(max(o_orderdate) AS DATE) AS last_order_date, count(*) AS order_count, round(sum(o_totalprice), 2) AS total_spend, {st('avg(o_totalprice)')} AS avg_spend, {st('stddev_samp(o_totalprice)')} AS spend_stddev, count(DISTINCT o_orderpriority) AS category_diversity,
CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_since_last_order, CASE WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{AS_OF}') > 90 THEN 1 ELSE 0 END AS is_churned FROM orders GROUP BY 1""")
def churn_features(spark, sf):
    out = gold.compute_churn_features(A.orders(spark, sf), AS_OF).withColumn("last_order_date", F.to_date("last_order_date"))
    return steady(rounded(out, 2, "total_spend"), "avg_spend", "spend_stddev")


@query(f"""WITH {A.FAULTY_SQL} SELECT customer_id, count(*) AS total_orders, round(sum(order_value), 2) AS total_revenue, {st('avg(order_value)')} AS avg_order_value, {st('sum(order_value) * 1.2')} AS clv_proxy, any_value(c_mktsegment) AS customer_segment
FROM faulty LEFT JOIN customer ON customer_id = c_custkey WHERE order_value BETWEEN 0 AND 1000000 GROUP BY 1""")
def customer_360(spark, sf):
    people = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_segment"))
    return steady(rounded(gold.customer_360(A.faulty_orders(spark, sf), people), 2, "total_revenue"), "avg_order_value", "clv_proxy")


@query("""SELECT o_custkey AS customer_id, round(sum(o_totalprice), 2) AS total_revenue FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def top_customers(spark, sf):
    sums = A.orders(spark, sf).groupBy("customer_id").agg(F.round(F.sum("order_value"), 2).alias("total_revenue"))
    return gold.top_customers(sums, 5)


@query(f"""SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS order_count, {st('avg(o_totalprice)')} AS avg_value, round(sum(o_totalprice), 2) AS total_value FROM orders GROUP BY 1""")
def daily_volume(spark, sf):
    return steady(rounded(gold.daily_volume(A.orders(spark, sf)), 2, "total_value"), "avg_value")


@query("""SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""")
def value_counts_topk(spark, sf):
    return gold.value_counts(A.table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 20)


@query(f"""WITH {A.PEOPLE_SQL} SELECT round(avg(CAST(coalesce(consent_marketing, false) AS INTEGER)), 6) AS marketing_rate, round(avg(CAST(coalesce(consent_data_processing, true) AS INTEGER)), 6) AS processing_rate, count(email) AS email_filled, count(phone) AS phone_filled, count(*) FILTER (email IS NOT NULL OR phone IS NOT NULL) AS rows_with_pii FROM people""")
def consent_report(spark, sf):
    return rounded(gold.consent_report(A.people(spark, sf), ["email", "phone"]), 6, "marketing_rate", "processing_rate")


@query(f"""WITH {A.PEOPLE_SQL}, v AS (SELECT 'phone' AS "column", phone AS value FROM people UNION ALL SELECT 'pincode', pincode FROM people)
SELECT "column", CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows FROM (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def duplicate_keys(spark, sf):
    return gold.duplicate_key_counts(A.people(spark, sf), ["phone", "pincode"])


# --- rows, sets, joins --------------------------------------------------------

FAULTY = f"WITH {A.FAULTY_SQL} "


@query(FAULTY + "SELECT order_id, copy, CAST(order_timestamp AS DATE) AS day FROM faulty QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY order_timestamp DESC, copy) = 1")
def dedup_latest(spark, sf):
    out = ranking.deduplicate(A.faulty_orders(spark, sf), ["order_id"], "order_timestamp", tie_breakers=["copy"])
    return out.select("order_id", F.col("copy"), F.to_date("order_timestamp").alias("day"))


@query(FAULTY + "SELECT DISTINCT order_id, customer_id, order_value FROM faulty")
def drop_duplicates(spark, sf):
    return ranking.drop_duplicates(A.faulty_orders(spark, sf).select("order_id", "customer_id", "order_value"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def except_distinct(spark, sf):
    o = A.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return ranking.except_distinct(A.table(spark, sf, "customer").select("c_custkey"), o)


@query("SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def except_all(spark, sf):
    o = A.table(spark, sf, "orders")
    return ranking.except_all(o.select("o_custkey", "o_orderstatus"), o.filter("o_orderkey % 3 = 0").select("o_custkey", "o_orderstatus"))


@query("SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS price FROM customer UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part")
def union_by_name(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"))
    return ranking.union_by_name([c, p], allow_missing=True).select("id", "name", "price")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def erasure_anti_join(spark, sf):
    gone = A.table(spark, sf, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return ranking.erase({"o": A.table(spark, sf, "orders").select("o_orderkey", "o_custkey")}, "o_custkey", gone)["o"]


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'")
def incremental_load(spark, sf):
    new = ingest.newer_than(A.table(spark, sf, "orders"), "o_orderdate", "2000-01-01 00:00:00")
    return new.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT c_custkey, sha256(concat_ws('||', CAST(c_custkey AS VARCHAR), coalesce(c_name, '__NULL__'), CASE WHEN c_custkey % 5 = 0 THEN '__NULL__' ELSE c_mktsegment END)) AS row_hash FROM customer")
def row_hash(spark, sf):
    c = A.table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", text.row_hash(["c_custkey", "c_name", "c_mktsegment"]).alias("row_hash"))


# --- checks, contracts --------------------------------------------------------


@query(FAULTY + "SELECT order_id, copy, CASE WHEN order_id IS NOT NULL AND customer_id IS NOT NULL AND order_value IS NOT NULL THEN 'valid' ELSE 'quarantine' END AS outcome FROM faulty")
def validate_not_null(spark, sf):
    good, bad = checks.validate_not_null(A.faulty_orders(spark, sf), ["order_id", "customer_id", "order_value"])
    cols = ["order_id", "copy"]
    return good.select(*cols, F.lit("valid").alias("outcome")).unionByName(bad.select(*cols, F.lit("quarantine").alias("outcome")))


@query(FAULTY + "SELECT order_id, copy, CASE WHEN order_value BETWEEN 0 AND 200000 THEN 'valid' ELSE 'quarantine' END AS outcome FROM faulty")
def validate_range(spark, sf):
    good, bad = checks.validate_value_ranges(A.faulty_orders(spark, sf), "order_value", 0, 200000)
    cols = ["order_id", "copy"]
    return good.select(*cols, F.lit("valid").alias("outcome")).unionByName(bad.select(*cols, F.lit("quarantine").alias("outcome")))


@query(FAULTY + """, c AS (SELECT count(*) AS n, count(*) FILTER (customer_id IS NULL) AS nc, count(*) FILTER (order_value IS NULL) AS nv, count(*) FILTER (order_value NOT BETWEEN 0 AND 1000000) AS rng, count(order_value) AS ov, count(*) FILTER (payment_method NOT IN ('UPI','Card','COD','Wallet','NetBanking')) AS pay,
  count(*) FILTER (NOT regexp_full_match(delivery_pincode, '[0-9]{6}')) AS pin, count(delivery_pincode) AS np FROM faulty), u AS (SELECT CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS dup FROM (SELECT count(*) AS k FROM faulty GROUP BY order_id))
SELECT 'not_null(order_id)' AS expectation, 0::BIGINT AS unexpected_count, n AS element_count, true AS success FROM c UNION ALL SELECT 'not_null(customer_id)', nc, n, nc = 0 FROM c UNION ALL SELECT 'not_null(order_value)', nv, n, nv = 0 FROM c UNION ALL
SELECT 'unique(order_id)', dup, n, dup = 0 FROM c, u UNION ALL SELECT 'between(order_value)', rng, ov, (ov - rng) / ov >= 0.99 FROM c UNION ALL SELECT 'in_set(payment_method)', pay, n, pay = 0 FROM c UNION ALL SELECT 'regex(delivery_pincode)', pin, np, pin = 0 FROM c""")
def expectation_counts(spark, sf):
    report = checks.validate_suite(A.faulty_orders(spark, sf), checks.ecommerce_suite()[1:])
    rows = [(r["expectation"], r["unexpected_count"], r["element_count"], r["success"]) for r in report["results"]]
    return spark.createDataFrame(rows, "expectation string, unexpected_count long, element_count long, success boolean")


@query(FAULTY + "SELECT order_id, copy, CASE WHEN customer_id IS NULL OR order_value IS NULL OR order_value NOT BETWEEN 0 AND 1000000 OR payment_method NOT IN ('UPI','Card','COD','Wallet','NetBanking') OR delivery_pincode IS NULL OR NOT regexp_full_match(delivery_pincode, '[0-9]{6}') THEN 'quarantine' ELSE 'valid' END AS outcome FROM faulty")
def suite_quarantine(spark, sf):
    good, bad, _ = checks.validate_and_quarantine(A.faulty_orders(spark, sf), checks.ecommerce_suite()[1:])
    cols = ["order_id", "copy"]
    return good.select(*cols, F.lit("valid").alias("outcome")).unionByName(bad.select(*cols, F.lit("quarantine").alias("outcome")))


CONTRACT = contracts.DataContract(
    "orders", "1.0.0", schema={"order_id": {"nullable": False, "unique": True}, "customer_id": {"nullable": False}, "order_value": {"nullable": True, "min": 0, "max": 300000}, "delivery_pincode": {"nullable": True, "regex": r"^\d{6}$"}},
    rules=[{"name": "positive_value", "condition": "order_value > 0"}, {"name": "known_status", "condition": "order_status IN ('F','O','P')"}],
)


@query(FAULTY + """, c AS (SELECT count(*) AS n, count(customer_id) AS cu, count(order_value) AS ov, count(*) FILTER (order_value >= 0) AS mn, count(*) FILTER (order_value <= 300000) AS mx, count(delivery_pincode) AS np, count(*) FILTER (regexp_full_match(delivery_pincode, '[0-9]{6}')) AS pin, count(*) FILTER (order_value > 0) AS pos, count(*) FILTER (order_status IN ('F','O','P')) AS st FROM faulty),
x AS (SELECT 'order_id_not_null' AS "check", n AS rows, n AS passing FROM c UNION ALL SELECT 'customer_id_not_null', n, cu FROM c UNION ALL SELECT 'order_value_min_0', ov, mn FROM c UNION ALL SELECT 'order_value_max_300000', ov, mx FROM c UNION ALL SELECT 'delivery_pincode_regex', np, pin FROM c UNION ALL SELECT 'positive_value', n, pos FROM c UNION ALL SELECT 'known_status', n, st FROM c)
SELECT "check", rows, passing, round(passing / rows * 100, 2) AS pass_rate, passing = rows AS passed FROM x""")
def contract_checks(spark, sf):
    df = A.faulty_orders(spark, sf)
    return checks.contract_counts(df, checks.contract_checks(CONTRACT, df)[0])


@query(FAULTY + "SELECT order_id, copy, CASE WHEN customer_id IS NULL OR coalesce(order_value < 0 OR order_value > 300000, false) OR NOT coalesce(regexp_full_match(delivery_pincode, '[0-9]{6}'), true) OR NOT coalesce(order_value > 0, false) OR NOT coalesce(order_status IN ('F','O','P'), false) THEN 'quarantine' ELSE 'valid' END AS outcome FROM faulty")
def contract_split(spark, sf):
    good, bad, _ = checks.enforce_contract(A.faulty_orders(spark, sf), CONTRACT)
    cols = ["order_id", "copy"]
    return good.select(*cols, F.lit("valid").alias("outcome")).unionByName(bad.select(*cols, F.lit("quarantine").alias("outcome")))


@query(FAULTY + """, g AS (SELECT order_id, count(*) AS n FROM faulty GROUP BY 1) SELECT 0::BIGINT AS null_order_id, (SELECT count(*) FROM faulty WHERE customer_id IS NULL) AS null_customer_id, (SELECT count(*) FROM faulty WHERE order_value IS NULL) AS null_order_value,
(SELECT count(*) FROM faulty WHERE order_value < 0) AS negative_value, (SELECT count(*) FROM faulty WHERE order_value > 1000000) AS extreme_value, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM g WHERE n > 1) AS duplicate_order_id""")
def rule_failure_counts(spark, sf):
    return checks.rule_failure_counts(A.faulty_orders(spark, sf))


@query(FAULTY + "SELECT order_id, copy, coalesce(order_value < 0, false) AS _is_negative, coalesce(order_value > 100000, false) AS _is_extreme FROM faulty")
def order_flags(spark, sf):
    return checks.order_flags(A.faulty_orders(spark, sf), 100_000).select("order_id", "copy", "_is_negative", "_is_extreme")


# --- data quality -------------------------------------------------------------


def pct(expr: str) -> str:
    return f"round({expr} / count(*) * 100, 2)"


@query(FAULTY + f"""SELECT 'customer_id' AS "column", {pct('count(customer_id)')} AS score FROM faulty UNION ALL SELECT 'order_value', {pct('count(order_value)')} FROM faulty""")
def completeness(spark, sf):
    return dq.long_measures(A.faulty_orders(spark, sf), dq.completeness(["customer_id", "order_value"]))


@query(FAULTY + f"""SELECT 'order_id' AS "column", {pct('count(DISTINCT order_id)')} AS score FROM faulty UNION ALL SELECT 'delivery_pincode', {pct('(count(DISTINCT delivery_pincode) + 1)')} FROM faulty""")
def uniqueness(spark, sf):
    return dq.long_measures(A.faulty_orders(spark, sf), dq.uniqueness(["order_id", "delivery_pincode"]))


@query(FAULTY + f"""SELECT 'delivery_pincode' AS "column", {pct("count(*) FILTER (regexp_full_match(delivery_pincode, '[0-9]{6}'))")} AS score FROM faulty""".replace("[0-9]6", "[0-9]{6}"))
def validity_regex(spark, sf):
    return dq.long_measures(A.faulty_orders(spark, sf), dq.validity({"delivery_pincode": r"^\d{6}$"}))


@query(f"""SELECT 'within_sla' AS "column", round(count(*) FILTER (date_diff('hour', o_orderdate, TIMESTAMP '{AS_OF}') <= 24000) / count(*) * 100, 2) AS score FROM orders UNION ALL SELECT 'avg_latency_hours', round(avg(date_diff('hour', o_orderdate, TIMESTAMP '{AS_OF}')), 2) FROM orders""")
def timeliness_asof(spark, sf):
    return dq.long_measures(A.orders(spark, sf), dq.timeliness("order_timestamp", F.lit(AS_OF), 24000))


@query(FAULTY + f"""SELECT 'positive' AS "column", {pct('count(*) FILTER (order_value > 0)')} AS score FROM faulty UNION ALL SELECT 'broken', 0.0""")
def consistency_rules(spark, sf):
    df = A.faulty_orders(spark, sf)
    return dq.long_measures(df, dq.consistency(df, [{"name": "positive", "condition": "order_value > 0"}, {"name": "broken", "condition": "no_such_column > 0"}]))


@query(FAULTY + f""", d AS (SELECT count(*) AS row_count, round((100.0 * 1 + {pct('count(customer_id)')} + {pct('count(order_value)')}) / 3, 2) AS completeness, round(({pct('count(DISTINCT order_id)')} + {pct('(count(DISTINCT customer_id) + 1)')} + {pct('(count(DISTINCT order_value) + 1)')}) / 3, 2) AS uniqueness,
 {pct("count(*) FILTER (regexp_full_match(delivery_pincode, '[0-9]{6}'))").replace('[0-9]6', '[0-9]{6}')} AS validity, 100.0 AS timeliness, {pct('count(*) FILTER (order_value > 0)')} AS consistency FROM faulty)
SELECT *, round((completeness + uniqueness + validity + timeliness + consistency) * 0.2, 1) AS overall_score FROM d""")
def overall_dq_score(spark, sf):
    out = dq.dq_metrics(A.faulty_orders(spark, sf), ["order_id", "customer_id", "order_value"], {"delivery_pincode": r"^\d{6}$"}, [{"name": "p", "condition": "order_value > 0"}])
    return rounded(out, 1, "overall_score")


PROFILE_COLUMNS = ["order_id", "customer_id", "order_value", "delivery_pincode", "payment_method"]


def _profile_sql(item: str) -> str:
    return FAULTY + " UNION ALL ".join(item.format(c=c) for c in PROFILE_COLUMNS)


@query(_profile_sql("""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 4) AS null_pct, count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_count FROM faulty"""))
def profile_nulls_distinct(spark, sf):
    return dq.profile_columns(A.faulty_orders(spark, sf).select(*PROFILE_COLUMNS)).select("column", "null_count", "null_pct", "distinct_count")


@query("""SELECT round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS stddev, round(kurtosis_pop(o_totalprice), 4) AS kurtosis,
round((avg(o_totalprice ** 3) - 3 * avg(o_totalprice) * avg(o_totalprice ** 2) + 2 * avg(o_totalprice) ** 3) / stddev_pop(o_totalprice) ** 3, 4) AS skewness, round(quantile_cont(o_totalprice, 0.25), 2) AS q25, round(quantile_cont(o_totalprice, 0.5), 2) AS q50, round(quantile_cont(o_totalprice, 0.99), 2) AS q99 FROM orders""")
def profile_numeric(spark, sf):
    p = dq.profile_columns(A.table(spark, sf, "orders").select("o_totalprice"), exact_percentiles=True)
    q = {f"q{int(x * 100)}": F.col("percentiles")[i] for i, x in enumerate(dq.PERCENTILES) if x in (0.25, 0.5, 0.99)}
    out = p.select(*[F.round(c, 2).alias(c) for c in ("min", "max", "mean", "stddev")], F.round("kurtosis", 4).alias("kurtosis"), F.round("skewness", 4).alias("skewness"), *[F.round(v, 2).alias(k) for k, v in q.items()])
    return out


@query("""SELECT 'text' AS "column", CAST(min(length(text)) AS DOUBLE) AS min_length, CAST(max(length(text)) AS DOUBLE) AS max_length, round(avg(length(text)), 2) AS avg_length, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS email_rows FROM documents""")
def profile_strings(spark, sf):
    p = dq.profile_columns(A.table(spark, sf, "documents").select("text"))
    return p.select("column", "min_length", "max_length", "avg_length", F.coalesce(F.col("pii")["email"], F.lit(0)).alias("email_rows"))


@query(FAULTY + """, v AS (SELECT 'payment_method' AS "column", payment_method AS value FROM faulty UNION ALL SELECT 'delivery_pincode', delivery_pincode FROM faulty), g AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT *, round(n / sum(n) OVER (PARTITION BY "column") * 100, 4) AS pct FROM g)
SELECT "column", value, n, pct, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM t WHERE value IS NOT NULL QUALIFY rank <= 20""")
def profile_top20(spark, sf):
    return dq.top_values(A.faulty_orders(spark, sf), ["payment_method", "delivery_pincode"], 20)


# --- anomalies and history ----------------------------------------------------


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS dq FROM lineitem) SELECT l_orderkey, l_linenumber, abs(l_extendedprice - m) / d > 1.5 AS price_flag, abs(l_extendedprice - m) / d > 1.5 OR abs(l_quantity - mq) / dq > 1.5 AS any_flag FROM lineitem, s""")
def zscore_flags(spark, sf):
    out, _ = anomaly.zscore_flags(A.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], 1.5)
    return out.select("l_orderkey", "l_linenumber", F.col("_anomaly_z_l_extendedprice").alias("price_flag"), F.col("_is_anomaly_zscore").alias("any_flag"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice < a - 0.5 * (b - a) OR l_extendedprice > b + 0.5 * (b - a) AS price_flag FROM lineitem, q""")
def iqr_flags(spark, sf):
    out, _ = anomaly.iqr_flags(A.table(spark, sf, "lineitem"), ["l_extendedprice"], 0.5, exact=True)
    return out.select("l_orderkey", "l_linenumber", F.col("_anomaly_iqr_l_extendedprice").alias("price_flag"))


@query()
def isolation_forest(spark, sf):
    out, _ = anomaly.isolation_forest(A.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"])
    return out.select("o_orderkey", "_anomaly_score_iforest", "_is_anomaly_iforest")


HISTORY = f"WITH {A.HISTORY_SQL} "


@query(HISTORY + """, w AS (SELECT run_seq, count(*) OVER l AS runs, avg(score) OVER l AS m, stddev_pop(score) OVER l AS s FROM history WINDOW l AS (ORDER BY run_seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT run_seq, runs, round(m, 4) AS mean_score, round(CASE WHEN runs >= 3 THEN greatest(70.0, least(99.0, m - 1.5 * s)) ELSE 85.0 END, 4) AS threshold FROM w""")
def rolling_threshold(spark, sf):
    return rounded(adaptive.rolling_thresholds(A.run_history(spark, sf)), 4, "mean_score", "threshold").select("run_seq", "runs", "mean_score", "threshold")


@query(HISTORY + """, w AS (SELECT run_seq, count(*) OVER l AS runs, regr_slope(score, run_seq) OVER l AS b FROM history WINDOW l AS (ORDER BY run_seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT run_seq, round(b, 4) AS slope, CASE WHEN runs < 3 THEN 'insufficient_history' WHEN b > 0.5 THEN 'improving' WHEN b < -0.5 THEN 'declining' ELSE 'stable' END AS status FROM w WHERE runs >= 3""")
def trend_slope(spark, sf):
    return rounded(adaptive.rolling_thresholds(A.run_history(spark, sf)), 4, "slope").filter("runs >= 3").select("run_seq", "slope", "status")


@query(HISTORY + """, w AS (SELECT run_seq, score, count(*) OVER p AS runs, avg(score) OVER p AS m, regr_slope(score, run_seq) OVER p AS b, coalesce(lag(score, 3) OVER o > lag(score, 2) OVER o AND lag(score, 2) OVER o > lag(score, 1) OVER o, false) AS declining FROM history WINDOW p AS (ORDER BY run_seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), o AS (ORDER BY run_seq))
SELECT run_seq, declining, CASE WHEN runs < 3 THEN 'none' WHEN declining AND score < m AND b < -1 THEN 'critical' WHEN declining AND b < -0.5 THEN 'warning' WHEN score < m THEN 'info' ELSE 'none' END AS alert_level FROM w""")
def early_warning(spark, sf):
    return adaptive.early_warnings(A.run_history(spark, sf)).select("run_seq", "declining", "alert_level")


@query(HISTORY + """, m AS (SELECT 'completeness' AS dimension, avg(a) AS mean FROM history UNION ALL SELECT 'validity', avg(b) FROM history) SELECT dimension, round(mean, 4) AS mean, round((1 / (mean + 1e-6)) / sum(1 / (mean + 1e-6)) OVER (), 4) AS weight FROM m""")
def inverse_mean_weights(spark, sf):
    return rounded(adaptive.inverse_mean_weights(A.run_history(spark, sf)), 4, "mean").select("dimension", "mean", "weight")


@query()
def regression_weights(spark, sf):
    found = adaptive.regression_weights(A.run_history(spark, sf), "events", ["completeness", "validity"])
    return spark.createDataFrame(list(found.items()), "dimension string, weight double")


@query(HISTORY + "SELECT 'score' AS metric, 50.0 AS current, count(*) AS runs, round((50.0 - avg(score)) / stddev_pop(score), 4) AS z, abs((50.0 - avg(score)) / stddev_pop(score)) > 3 AS is_anomaly FROM history")
def batch_anomaly(spark, sf):
    values = A.run_history(spark, sf).select(F.lit("score").alias("metric"), F.col("score").alias("value"))
    return rounded(anomaly.batch_anomaly(values, {"score": 50.0}), 4, "z").select("metric", "current", "runs", "z", "is_anomaly")


# --- personal data ------------------------------------------------------------

RE2 = {k: v.replace("'", "''") for k, v in pii.PATTERNS.items()}
TYPES = ("EMAIL", "CREDIT_CARD", "IPV4", "PHONE_NUMBER")


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{RE2[t]}')) AS {t.lower()}" for t in TYPES) + " FROM documents")
def pii_type_counts(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", *[c.cast("long").alias(t.lower()) for t, c in pii.type_counts(F.col("text"), TYPES).items()])


@query("SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{RE2[t]}')" for t in TYPES) + " AS has_pii FROM documents")
def pii_has(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", pii.has_pii(F.col("text"), TYPES).alias("has_pii"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{RE2['EMAIL']}', '[REDACTED:EMAIL]', 'g')) AS masked_md5 FROM documents")
def pii_redact(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.md5(F.encode(pii.redact_type(F.col("text"), "EMAIL"), "UTF-8")).alias("masked_md5"))


@query()
def pii_mask_text(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.md5(F.encode(pii.mask_column(F.col("text"), "redact"), "UTF-8")).alias("masked_md5"))


@query()
def pii_spans(spark, sf):
    found = A.table(spark, sf, "documents").select("doc_id", F.explode(pii.span_column(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.type", "s.start", "s.end", "s.score")


@query(f"SELECT c_custkey, substr(sha256('{text.SALT}' || c_name), 1, greatest(length(c_name), 8)) AS hashed FROM customer")
def pii_hash_column(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", pii.mask_whole(F.col("c_name"), "hash").alias("hashed"))


@query()
def pii_tokenize(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", pii.mask_whole(F.col("c_name"), "tokenize").alias("token"))


@query(f"WITH {A.PEOPLE_SQL} SELECT 'people' AS \"table\", 'email' AS \"column\", 'EMAIL' AS entity_type, count(*) FILTER (email IS NOT NULL) AS rows_with_pii, CAST(count(*) FILTER (email IS NOT NULL) AS BIGINT) AS occurrences FROM people UNION ALL SELECT 'people', 'phone', 'PHONE_NUMBER', count(phone), count(phone) FROM people")
def pii_audit(spark, sf):
    return pii.residual_audit({"people": A.people(spark, sf).select("email", "phone")}, ["EMAIL", "PHONE_NUMBER"])


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?im)^(Agent|Customer|Bot|System|Support|User)\\s*:\\s*', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM (SELECT conv_id, turn, role || ' : ' || text AS text FROM conversations)")
def chat_clean(spark, sf):
    c = A.table(spark, sf, "conversations").withColumn("text", F.concat("role", F.lit(" : "), "text"))
    return c.select("conv_id", "turn", text.chat_clean(F.col("text")).alias("cleaned"))


FB = f"WITH {A.FEEDBACK_SQL} "


@query(FB + """, c AS (SELECT entity_type, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM fb GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c) SELECT entity_type, tp, fp, fn, tn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM r""")
def pii_metrics(spark, sf):
    return pii.entity_metrics(A.feedback(spark, sf))


GRID_SQL = """, g AS (SELECT entity_type, i AS step, count(*) FILTER (score >= 0.5 + i * (0.49 / 49) - 1e-9 AND actual) AS tp, count(*) FILTER (score >= 0.5 + i * (0.49 / 49) - 1e-9 AND NOT actual) AS fp, count(*) FILTER (NOT score >= 0.5 + i * (0.49 / 49) - 1e-9 AND actual) AS fn, count(*) AS events FROM fb, range(50) r(i) GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM g), f AS (SELECT *, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM r) """


@query(FB + GRID_SQL + "SELECT entity_type, CAST(step AS INTEGER) AS step, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, f1 FROM f")
def pii_threshold_grid(spark, sf):
    return pii.threshold_grid(A.feedback(spark, sf)).select("entity_type", "step", "tp", "fp", "fn", "f1")


@query(FB + GRID_SQL + "SELECT entity_type, events, CASE WHEN events >= 20 THEN round(0.5 + step * (0.49 / 49), 6) ELSE 0.85 END AS threshold FROM f QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY f1 DESC, step) = 1")
def pii_tuned_thresholds(spark, sf):
    return pii.tune_thresholds(A.feedback(spark, sf))


@query(FB + """, q AS (SELECT quantile_disc(seq, 0.75) AS cut FROM fb), s AS (SELECT entity_type, count(*) FILTER (seq <= cut) AS earlier_events, count(*) FILTER (seq > cut) AS recent_events, count(*) FILTER (seq <= cut AND actual AND NOT predicted) / greatest(count(*) FILTER (seq <= cut AND actual), 1) AS e, count(*) FILTER (seq > cut AND actual AND NOT predicted) / greatest(count(*) FILTER (seq > cut AND actual), 1) AS r FROM fb, q GROUP BY 1)
SELECT entity_type, earlier_events, recent_events, round(e, 4) AS earlier_fn_rate, round(r, 4) AS recent_fn_rate, (earlier_events = 0 AND recent_events > 0) AS new_type, (earlier_events = 0 AND recent_events > 0) OR round(r, 4) - round(e, 4) > 0.05 AS drift FROM s""")
def pii_drift(spark, sf):
    return pii.pii_drift(A.feedback(spark, sf), "seq")


# --- entities, history tables -------------------------------------------------

PEOPLE = f"WITH RECURSIVE {A.PEOPLE_SQL}"
SOUNDEX_SQL = """, z AS (SELECT *, upper(trim(first_name || ' ' || last_name)) AS up FROM people), z1 AS (SELECT *, translate(regexp_replace(up, '[^BFPVCGJKQSXZDTLMNR]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556') AS d FROM z),
z2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS runs FROM z1),
keyed AS (SELECT *, substr(rpad(substr(up, 1, 1) || CASE WHEN regexp_matches(up, '^[BFPVCGJKQSXZDTLMNR]') THEN substr(runs, 2) ELSE runs END, 12, '0'), 1, 4) AS soundex, lower(trim(email)) AS be, regexp_extract(regexp_replace(phone, '[\\s\\-\\+]', '', 'g'), '(\\d{6})$', 1) AS bp, lower(city) || '_' || substr(pincode, 1, 3) AS geo FROM z2)"""


@query(PEOPLE + SOUNDEX_SQL + " SELECT customer_id, be AS _block_email, bp AS _block_phone_tail, soundex AS _block_soundex, geo AS _block_geo FROM keyed")
def blocking_keys(spark, sf):
    return entity.blocking_keys(A.people(spark, sf)).select("customer_id", "_block_email", "_block_phone_tail", "_block_soundex", "_block_geo")


@query(PEOPLE + ", g AS (SELECT phone, pincode, min(customer_id) AS golden FROM people WHERE phone IS NOT NULL GROUP BY 1, 2) SELECT customer_id, coalesce(golden, customer_id) AS _golden_id FROM people LEFT JOIN g USING (phone, pincode)")
def exact_match_golden(spark, sf):
    return entity.exact_match_dedup(A.people(spark, sf), ["phone", "pincode"]).select("customer_id", "_golden_id")


FUZZY_SQL = PEOPLE + SOUNDEX_SQL + ", pairs AS (SELECT l.customer_id AS id_left, r.customer_id AS id_right FROM keyed l JOIN keyed r ON l.soundex = r.soundex AND l.customer_id < r.customer_id AND l.be = r.be AND l.bp = r.bp AND l.bp <> '' WHERE jaro_similarity(upper(l.first_name || ' ' || l.last_name), upper(r.first_name || ' ' || r.last_name)) >= 0.5)"


@query(FUZZY_SQL + " SELECT id_left, id_right FROM pairs")
def fuzzy_pairs(spark, sf):
    return entity.fuzzy_pairs(A.people(spark, sf)).select("id_left", "id_right")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_partkey + 7 AS b FROM lineitem WHERE l_partkey % 5 = 0 AND l_orderkey % 3 = 0), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS m FROM s UNION SELECT s.y, r.m FROM r JOIN s ON s.x = r.node) SELECT node, min(m) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    from tessera.operators.graph import connected_components

    e = A.table(spark, sf, "lineitem").filter("l_partkey % 5 = 0 AND l_orderkey % 3 = 0").select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + 7).alias("b"))
    return connected_components(e, "a", "b")


# No SQL: the chains have as many hops as parts / 7, which the recursion takes one by one.
@query()
def components_whole(spark, sf):
    from tessera.operators.graph import connected_components

    e = A.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + 7).alias("b"))
    return connected_components(e, "a", "b")


@query(FUZZY_SQL + ", gid AS (SELECT p.*, coalesce((SELECT min(id_left) FROM pairs WHERE id_right = p.customer_id), p.customer_id) AS g FROM people p) SELECT g AS _golden_id, arg_max(customer_id, (registration_date, -customer_id)) AS customer_id, bool_or(consent_marketing) AS consent_marketing, bool_or(consent_data_processing) AS consent_data_processing FROM gid GROUP BY 1")
def golden_records(spark, sf):
    linked = entity.fuzzy_match_link(A.people(spark, sf))
    return entity.golden_records(linked, "registration_date").select("_golden_id", "customer_id", "consent_marketing", "consent_data_processing")


@query("""WITH old AS (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_custkey % 7 <> 0), new AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 11 <> 0)
SELECT old.c_custkey, old.seg AS c_mktsegment, CAST(1 AS INTEGER) AS _version, new.seg IS NULL OR new.seg = old.seg AS _is_current, CASE WHEN new.seg IS NOT NULL AND new.seg <> old.seg THEN DATE '2024-06-01' END AS _valid_to FROM old LEFT JOIN new USING (c_custkey) UNION ALL
SELECT new.c_custkey, new.seg, CASE WHEN old.seg IS NULL THEN 1 ELSE 2 END, true, NULL FROM new LEFT JOIN old USING (c_custkey) WHERE old.seg IS NULL OR old.seg <> new.seg""")
def scd2_apply(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    old = scd.initialise(c.filter("c_custkey % 7 <> 0"), ["c_mktsegment"], "2024-01-01")
    new = c.filter("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    out = scd.apply_changes(old, new, ["c_custkey"], ["c_mktsegment"], "2024-06-01")
    return out.select("c_custkey", "c_mktsegment", "_version", "_is_current", F.to_date("_valid_to").alias("_valid_to"))


# --- products, finance, streams, stress ---------------------------------------

PRODUCT_SQL = """p AS (SELECT 'supplier' || s_suppkey AS product, 'nation' || s_nationkey AS domain, 80 + s_suppkey % 20 AS dq, s_suppkey % 3 <> 0 AS masked, s_suppkey % 40 AS hours, s_suppkey % 50 <> 0 AS enc FROM supplier)"""


@query(f"""WITH {PRODUCT_SQL}, c AS (SELECT *, CAST(dq >= 85 AS BIGINT) + CAST(masked AS BIGINT) + CAST(hours <= 24 AS BIGINT) + CAST(enc AS BIGINT) + 1 AS passed, CAST(dq < 85 AS BIGINT) + CAST(NOT masked AS BIGINT) + CAST(NOT enc AS BIGINT) AS critical FROM p)
SELECT product, domain, 5::BIGINT AS total_policies, passed, 5 - passed AS failed, critical AS critical_failures, critical = 0 AS certified FROM c""")
def mesh_audit(spark, sf):
    s = A.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    products = s.select(F.concat(F.lit("supplier"), k).alias("product"), F.concat(F.lit("nation"), "s_nationkey").alias("domain"), (80 + k % 20).cast("double").alias("dq_score"), (k % 3 != 0).alias("pii_masked"), (k % 40).cast("double").alias("freshness_hours"), (k % 50 != 0).alias("has_encryption"))
    return mesh.audit_products(products, mesh.DEFAULT_POLICIES)


@query(HISTORY + """, s AS (SELECT 'completeness' AS dimension, round(min(score), 2) AS score_before, round(max(score), 2) AS score_after, 25000.0 AS cost FROM history UNION ALL SELECT 'validity', round(min(b), 2), round(max(b), 2), 18000.0 FROM history)
SELECT dimension, score_before, score_after, round(score_after - score_before, 2) AS gap_reduction_pct, round((score_after - score_before) * cost, 2) AS monthly_saving, round((score_after - score_before) * cost * 12, 2) AS annual_saving FROM s""")
def roi_dimension(spark, sf):
    h = A.run_history(spark, sf)
    ends = h.agg(F.round(F.min("score"), 2).alias("a"), F.round(F.max("score"), 2).alias("b"), F.round(F.min(F.col("dims")["validity"]), 2).alias("c"), F.round(F.max(F.col("dims")["validity"]), 2).alias("d"))
    scores = ends.select(F.explode(F.array(F.struct(F.lit("completeness").alias("dimension"), F.col("a").alias("score_before"), F.col("b").alias("score_after")), F.struct(F.lit("validity").alias("dimension"), F.col("c").alias("score_before"), F.col("d").alias("score_after")))).alias("x")).select("x.*")
    return roi.dimension_roi(scores).drop("primary_kpi")


@query("SELECT 'timeliness' AS dimension, CAST(t AS DOUBLE) AS target_score, round(t - 72.5, 2) AS improvement_pct, round((t - 72.5) * 30000, 2) AS monthly_saving, round((t - 72.5) * 360000, 2) AS annual_saving FROM (VALUES (70.0), (75.0), (80.0), (85.0), (90.0), (95.0), (100.0)) v(t)")
def roi_sensitivity(spark, sf):
    return roi.sensitivity(spark, "timeliness", 72.5)


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS events, round(sum(value), 2) AS total_value FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf):
    out = streaming.tumbling_counts(A.table(spark, sf, "events"), "ts", ["event_type"], "1 day", value="value")
    return out.select(F.to_date("window_start").alias("day"), "event_type", "events", F.round("total_value", 2).alias("total_value"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, count(*) AS events, CAST(count(DISTINCT k) AS BIGINT) AS sessions FROM g GROUP BY 1""")
def session_windows(spark, sf):
    out = streaming.session_counts(A.table(spark, sf, "events"), "ts", "user_id", "12 hours")
    return out.groupBy("user_id").agg(F.sum("events").alias("events"), F.count("*").alias("sessions"))


@query()
def stress_poison(spark, sf):
    o = A.orders(spark, sf).withColumn("delivery_notes", F.lit("leave at the door"))
    return generators.poison_summary(generators.poisoned(o, generators.PROFILES["mixed"]))


@query()
def streaming_ingest(spark, sf):
    """Events as files, through the governed stream, back as a table."""
    from tessera.sources.shared import shared_dir
    import uuid

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = A.table(spark, sf, "events")
    as_json = events.select(F.col("event_id").cast("string"), F.lit(None).cast("string").alias("session_id"), F.col("user_id").cast("string"), "event_type", F.col("ts").cast("string").alias("timestamp"), F.concat(F.lit("mail me at u"), "user_id", F.lit("@example.com")).alias("search_query"))
    as_json.write.json(f"{root}/in")
    streaming.run_available(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type", "search_query", F.to_date("_event_ts").alias("event_date"))


@query("""SELECT 'a' AS kind, CAST(count(*) AS BIGINT) AS rows FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', count(*) FROM orders UNION ALL SELECT 'c', count(*) FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 <> 1""")
def snapshot_time_travel(spark, sf):
    """A table's first, second and third version: append, then delete."""
    import uuid

    from tessera.sources.shared import shared_dir
    from tessera.sources.store import SnapshotStore

    store = SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    store.append(o.filter("o_orderkey % 2 = 0"), "orders")
    store.append(o.filter("o_orderkey % 2 <> 0"), "orders")
    store.delete("orders", "o_orderkey % 4 = 1")
    counts = [store.read("orders", v).agg(F.lit(k).alias("kind"), F.count("*").alias("rows")) for v, k in enumerate("abc")]
    return ranking.union_by_name(counts)


@query("SELECT 'added' AS change, 'o_extra' AS \"column\" UNION ALL SELECT 'removed', 'o_orderstatus' UNION ALL SELECT 'type', 'o_totalprice'")
def schema_drift(spark, sf):
    o = A.table(spark, sf, "orders")
    new = o.drop("o_orderstatus").withColumn("o_extra", F.lit(1)).withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    d = ingest.schema_diff(o.schema, new.schema)
    rows = [("added", c) for c in d["added"]] + [("removed", c) for c in d["removed"]] + [("type", t["column"]) for t in d["type_changes"]]
    return spark.createDataFrame(rows, "change string, column string")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_mktsegment))")
def grouping_sets(spark, sf):
    c = A.table(spark, sf, "customer")
    return c.groupingSets([["c_nationkey", "c_mktsegment"], ["c_mktsegment"]], "c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS row_number FROM orders")
def global_row_number(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.global_row_number(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])[0].select("o_orderkey", "row_number")


