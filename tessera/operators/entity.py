"""Entity resolution: blocking, fuzzy linkage, components, golden records."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import soundex_variant
from tessera.operators.graph import connected_components

WEIGHTS = {"name": 0.40, "email": 0.35, "phone": 0.25}
THRESHOLD = 0.80


def blocking_keys(df: DataFrame) -> DataFrame:
    """``_block_email``, ``_block_phone_tail``, ``_block_soundex``, ``_block_geo``."""
    return df.withColumns({
        "_block_email": F.lower(F.trim("email")),
        "_block_phone_tail": F.regexp_extract(F.regexp_replace("phone", r"[\s\-\+]", ""), r"(\d{6})$", 1),
        "_block_soundex": soundex_variant(F.concat_ws(" ", "first_name", "last_name")),
        "_block_geo": F.concat_ws("_", F.lower("city"), F.substring("pincode", 1, 3)),
    })


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro similarity with a prefix bonus of 0.1 per common letter, four at most, always."""
    a, b = (a or "").upper(), (b or "").upper()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def batch(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([jaro_winkler(s, t) for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return batch(a, b)


def exact_match_dedup(df: DataFrame, match_columns: Sequence[str], id_column: str = "customer_id") -> DataFrame:
    """``_golden_id``: the smallest id among rows that agree on all match columns.

    Rows with a null among them match nobody and keep their own id.  All rows stay.
    """
    known = F.lit(True)
    for c in match_columns:
        known = known & F.col(c).isNotNull()
    groups = df.filter(known).groupBy(*match_columns).agg(F.min(id_column).alias("_golden"))
    return df.join(groups, list(match_columns), "left").withColumn("_golden_id", F.coalesce("_golden", id_column)).drop("_golden").select(*df.columns, "_golden_id")


def required_equalities(weights: dict[str, float], threshold: float) -> list[str]:
    """Features without which the threshold cannot be reached: they can be join keys."""
    return [k for k in ("email", "phone") if sum(weights.values()) - weights[k] < threshold - 1e-12]


def fuzzy_pairs(df: DataFrame, id_column: str = "customer_id", threshold: float = THRESHOLD, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id_left, id_right, score) of pairs in a block that reach the threshold.

    Blocks are soundex codes; whatever the weights make necessary (equal e-mail, equal
    phone tail) joins the block key, which keeps common names from pairing up.
    """
    need = required_equalities(weights, threshold)
    name = F.concat_ws(" ", "first_name", "last_name").alias("name")
    rows = blocking_keys(df).select(F.col(id_column).alias("id"), name, F.col("_block_email").alias("email"), F.col("_block_phone_tail").alias("phone"), F.col("_block_soundex").alias("soundex"))
    if "phone" in need:
        rows = rows.filter(F.col("phone") != "")
    left, right = (rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns]) for s in "lr")
    cond = (F.col("l_soundex") == F.col("r_soundex")) & (F.col("l_id") < F.col("r_id"))
    for k in need:
        cond = cond & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    same_email = F.coalesce(F.col("l_email") == F.col("r_email"), F.lit(False)).cast("double")
    same_phone = F.coalesce((F.col("l_phone") == F.col("r_phone")) & (F.col("l_phone") != ""), F.lit(False)).cast("double")
    pairs = left.join(right, cond).withColumn("name_sim", jaro_winkler_column(F.col("l_name"), F.col("r_name")))
    score = F.col("name_sim") * weights["name"] + same_email * weights["email"] + same_phone * weights["phone"]
    return pairs.withColumn("score", score).filter(F.col("score") >= threshold).select(F.col("l_id").alias("id_left"), F.col("r_id").alias("id_right"), "score")


def resolve(df: DataFrame, pairs: DataFrame, id_column: str = "customer_id", max_rounds: int = 50) -> DataFrame:
    """``df`` with ``_golden_id``, the smallest id of its component of pairs."""
    groups = connected_components(pairs, "id_left", "id_right", max_rounds)
    return df.join(groups, df[id_column] == groups["node"], "left").withColumn("_golden_id", F.coalesce("component", id_column)).select(*df.columns, "_golden_id")


def fuzzy_match_link(df: DataFrame, id_column: str = "customer_id", threshold: float = THRESHOLD) -> DataFrame:
    return resolve(df, fuzzy_pairs(df, id_column, threshold), id_column)


def golden_records(resolved: DataFrame, recency_col: str, id_column: str = "customer_id") -> DataFrame:
    """The most recent row of each golden id (ties by id), consent flags or-ed over the group."""
    w = Window.partitionBy("_golden_id").orderBy(F.col(recency_col).desc_nulls_last(), id_column)
    whole = Window.partitionBy("_golden_id")
    consents = {c: F.coalesce(F.bool_or(c).over(whole), F.col(c)) for c in resolved.columns if c.startswith("consent_")}
    out = resolved.withColumn("__tessera_rn", F.row_number().over(w))
    return (out.withColumns(consents) if consents else out).filter("__tessera_rn = 1").drop("__tessera_rn")


def hash_identifiers(df: DataFrame, columns: Sequence[str] = ("aadhaar", "pan_card", "email", "phone")) -> DataFrame:
    here = {c: F.sha2(F.col(c).cast("string"), 256) for c in columns if c in df.columns}
    return df.withColumns(here) if here else df
