"""Row checks compiled once and shared by splits, expectation suites and contracts.

A check is a condition that a good row meets, with a rule for what null means.
Suites and contracts compute all their counts in a single aggregation; splits tag
each row with the names of the checks it fails, so valid and quarantined rows
together are exactly the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``condition`` over the row; ``null_passes`` decides rows where it is null."""

    name: str
    condition: str | Column
    null_passes: bool = False
    mostly: float = 1.0
    over_non_null: str | None = None  # pass rates count only rows where this column is filled

    def column(self) -> Column:
        return F.expr(self.condition) if isinstance(self.condition, str) else self.condition

    def passes(self) -> Column:
        return F.coalesce(self.column(), F.lit(self.null_passes))


def _q(name: str) -> str:
    return f"`{name}`"


def not_null(column: str) -> Check:
    return Check(f"{column}_not_null", F.col(_q(column)).isNotNull())


def between(column: str, low: float | None = None, high: float | None = None, mostly: float = 1.0, null_passes: bool = False) -> Check:
    c = F.expr(f"try_cast({_q(column)} AS double)")
    cond = F.lit(True)
    if low is not None:
        cond = cond & (c >= low)
    if high is not None:
        cond = cond & (c <= high)
    return Check(f"{column}_between", F.when(c.isNotNull(), cond), null_passes, mostly, column)


def in_set(column: str, values: Sequence[Any], mostly: float = 1.0) -> Check:
    return Check(f"{column}_in_set", F.col(_q(column)).isin(*values), False, mostly, column)


def matches(column: str, regex: str, mostly: float = 1.0, null_passes: bool = False) -> Check:
    return Check(f"{column}_regex", F.col(_q(column)).cast("string").rlike(regex), null_passes, mostly, column)


def tagged(df: DataFrame, checks: Sequence[Check], name: str = "_violations") -> DataFrame:
    """``df`` with the names of the failed checks of each row."""
    failed = [F.when(~c.passes(), F.lit(c.name)) for c in checks]
    empty = F.array().cast("array<string>")
    return df.withColumn(name, F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else empty)


def split(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) with multiplicity kept; quarantined rows carry ``_violations``."""
    t = tagged(df, checks)
    return t.filter(F.size("_violations") == 0).drop("_violations"), t.filter(F.size("_violations") > 0)


def validate_not_null(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return split(df, [not_null(c) for c in columns if c in df.columns])


def validate_value_ranges(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    return split(df, [between(column, low, high)])


# --- expectation suites -------------------------------------------------------


@dataclass(frozen=True)
class Expectation:
    """kind: columns, subset, not_null, unique, between, in_set, regex."""

    kind: str
    column: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    mostly: float = 1.0

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column or ''})"

    def check(self) -> Check | None:
        """Row-level violation test; table-level and uniqueness expectations have none."""
        if self.kind == "not_null":
            return not_null(self.column)
        if self.kind == "between":
            return between(self.column, self.args.get("min"), self.args.get("max"), self.mostly)
        if self.kind == "in_set":
            return in_set(self.column, self.args["values"], self.mostly)
        if self.kind == "regex":
            return matches(self.column, self.args["regex"], self.mostly)
        return None


#: Fixed values of the order suite.
ORDER_COLUMNS = ["order_id", "customer_id", "product_category", "order_value", "delivery_instructions", "customer_review", "order_timestamp", "delivery_city", "delivery_pincode", "payment_method"]
PAYMENT_METHODS = ["UPI", "Card", "COD", "Wallet", "NetBanking"]
PINCODE = r"^\d{6}$"


def ecommerce_suite() -> list[Expectation]:
    """Rules R1 to R8 of the order table."""
    return [
        Expectation("columns", args={"columns": ORDER_COLUMNS}),
        *[Expectation("not_null", c) for c in ("order_id", "customer_id", "order_value")],
        Expectation("unique", "order_id"),
        Expectation("between", "order_value", {"min": 0.0, "max": 1_000_000.0}, 0.99),
        Expectation("in_set", "payment_method", {"values": PAYMENT_METHODS}),
        Expectation("regex", "delivery_pincode", {"regex": PINCODE}),
    ]


def suite_from_schema(schema: dict[str, dict[str, Any]], rules: Sequence[Expectation] = ()) -> list[Expectation]:
    """Expectations from per-column settings: nullable (default no), unique, min, max, regex, valid_values."""
    out = [Expectation("subset", args={"columns": list(schema)})]
    for column, spec in schema.items():
        if not spec.get("nullable", False):
            out.append(Expectation("not_null", column))
        if spec.get("unique"):
            out.append(Expectation("unique", column))
        if spec.get("min") is not None or spec.get("max") is not None:
            out.append(Expectation("between", column, {"min": spec.get("min"), "max": spec.get("max")}))
        if spec.get("regex"):
            out.append(Expectation("regex", column, {"regex": spec["regex"]}))
        if spec.get("valid_values"):
            out.append(Expectation("in_set", column, {"values": spec["valid_values"]}))
    return [*out, *rules]


def validate_suite(df: DataFrame, suite: Sequence[Expectation]) -> dict[str, Any]:
    """All unexpected counts in one aggregation (plus one grouped count per unique column).

    As usual, column expectations count over filled values; not-null over all rows.
    An expectation on a missing column fails.
    """
    measures, results = {"_rows": F.count("*")}, []
    for i, e in enumerate(suite):
        if e.column is not None and e.column not in df.columns:
            continue
        if (c := e.check()) is not None:
            over = F.lit(True) if c.over_non_null is None else F.col(_q(c.over_non_null)).isNotNull()
            measures[f"bad{i}"] = F.count_if(over & ~c.passes())
            measures[f"of{i}"] = F.count_if(over)
        elif e.kind == "unique":
            measures[f"of{i}"] = F.count(_q(e.column))
    row = df.agg(*[m.alias(k) for k, m in measures.items()]).first()
    for i, e in enumerate(suite):
        bad = of = None
        if e.kind == "columns":
            ok = df.columns == list(e.args["columns"])
        elif e.kind == "subset":
            ok = set(e.args["columns"]) <= set(df.columns)
        elif e.column not in df.columns:
            ok = False
        else:
            of = row[f"of{i}"]
            if e.kind == "unique":
                counts = df.filter(F.col(_q(e.column)).isNotNull()).groupBy(_q(e.column)).agg(F.count("*").alias("n"))
                bad = counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).first()[0]
            else:
                bad = row[f"bad{i}"]
            ok = bad == 0 if e.mostly >= 1 else of == 0 or (of - bad) / of >= e.mostly
        results.append({"expectation": e.name, "success": ok, "unexpected_count": bad, "element_count": of})
    passed = sum(r["success"] for r in results)
    return {"rows": row["_rows"], "results": results, "passed": passed, "total": len(results), "dq_score": passed / len(results) if results else 1.0}


def validate_and_quarantine(df: DataFrame, suite: Sequence[Expectation]) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """Only failed expectations put rows into quarantine: those of a passed ``mostly`` rule stay valid."""
    report = validate_suite(df, suite)
    failed = [e for e, r in zip(suite, report["results"], strict=True) if not r["success"]]
    checks = [c for e in failed if e.column in df.columns and (c := e.check()) is not None]
    return *split(df, checks), report


# --- order model --------------------------------------------------------------

#: Fixed values of the order model.
UUID4 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def order_model_checks(categories: Sequence[str] = (), payments: Sequence[str] = PAYMENT_METHODS) -> list[Check]:
    """Row contract of an order: UUID keys, enumerations, value not negative, pincode."""
    out = [matches("order_id", UUID4), matches("customer_id", UUID4), between("order_value", 0.0), matches("delivery_pincode", PINCODE), in_set("payment_method", payments)]
    return [*out, in_set("product_category", categories)] if categories else out


def order_flags(orders: DataFrame, extreme: float = 500_000.0) -> DataFrame:
    v = F.col("order_value")
    return orders.withColumns({"_is_negative": F.coalesce(v < 0, F.lit(False)), "_is_extreme": F.coalesce(v > extreme, F.lit(False))})


def rule_failure_counts(orders: DataFrame) -> DataFrame:
    """Failures per rule in one pass over rows grouped by id."""
    by_id = orders.groupBy("order_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("customer_id").isNull()).alias("c"), F.count_if(F.col("order_value").isNull()).alias("v"),
        F.count_if(F.col("order_value") < 0).alias("neg"), F.count_if(F.col("order_value") > 1_000_000).alias("big"),
    )
    known = F.col("order_id").isNotNull()
    return by_id.agg(
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_order_id"), F.coalesce(F.sum("c"), F.lit(0)).alias("null_customer_id"), F.coalesce(F.sum("v"), F.lit(0)).alias("null_order_value"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negative_value"), F.coalesce(F.sum("big"), F.lit(0)).alias("extreme_value"),
        F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("duplicate_order_id"),
    )


# --- contracts ----------------------------------------------------------------


def contract_checks(contract, df: DataFrame) -> tuple[list[Check], list[dict[str, Any]]]:
    """Checks of a contract, and entries for rules that cannot be analysed (they fail)."""
    checks, broken = [], []
    for column, spec in contract.schema.items():
        if column not in df.columns:
            broken.append({"check": f"{column}_present", "passed": False, "pass_rate": 0.0, "error": "missing column"})
            continue
        c, nullable = F.col(_q(column)), spec.get("nullable", True)
        if not nullable:
            checks.append(not_null(column))
        for key, cond in (("min", lambda v, c=c: c >= v), ("max", lambda v, c=c: c <= v)):
            if spec.get(key) is not None:
                checks.append(Check(f"{column}_{key}_{spec[key]}", cond(spec[key]), True, over_non_null=column))
        if spec.get("regex"):
            checks.append(Check(f"{column}_regex", c.cast("string").rlike(spec["regex"]), True, over_non_null=column))
    for rule in contract.rules:
        check = Check(rule.get("name", "unnamed"), rule.get("condition", "true"))
        try:
            df.select(check.column().cast("boolean"))
            checks.append(check)
        except AnalysisException as e:
            broken.append({"check": check.name, "passed": False, "pass_rate": 0.0, "error": str(e).splitlines()[0]})
    return checks, broken


def contract_counts(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: rows counted, rows passing, pass rate; a single scan."""
    sums = []
    for i, c in enumerate(checks):
        over = F.lit(True) if c.over_non_null is None else F.col(_q(c.over_non_null)).isNotNull()
        sums += [F.count_if(over).alias(f"of{i}"), F.count_if(over & c.passes()).alias(f"ok{i}")]
    items = [F.struct(F.lit(c.name).alias("check"), F.col(f"of{i}").alias("rows"), F.col(f"ok{i}").alias("passing")) for i, c in enumerate(checks)]
    out = df.agg(*sums).select(F.explode(F.array(*items)).alias("x")).select("x.*")
    rate = F.when(F.col("rows") > 0, F.round(F.col("passing") / F.col("rows") * 100, 2)).otherwise(100.0)
    return out.withColumn("pass_rate", rate).withColumn("passed", F.col("passing") == F.col("rows"))


def enforce_contract(df: DataFrame, contract) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(valid, quarantine, report): quarantined rows carry the checks they fail."""
    checks, broken = contract_checks(contract, df)
    results = [r.asDict() for r in contract_counts(df, checks).collect()] if checks else []
    results = [{"check": r["check"], "passed": r["passed"], "pass_rate": r["pass_rate"]} for r in results] + broken
    passed = sum(r["passed"] for r in results)
    score = round(passed / len(results) * 100, 2) if results else 100.0
    valid, bad = split(df, checks)
    bad = bad.withColumn("_quarantine_reason", F.concat_ws(",", "_violations")).drop("_violations").withColumn("_quarantine_ts", F.current_timestamp())
    minimum = contract.sla.get("min_dq_score", 85)
    return valid, bad, {"contract": contract.name, "version": contract.version, "checks": results, "score": score, "sla_met": score >= minimum}


def unique_check(df: DataFrame, column: str) -> DataFrame:
    """Rows whose (filled) value occurs more than once."""
    n = F.count("*").over(Window.partitionBy(column))
    return df.withColumn("_n", n).filter(F.col(column).isNotNull() & (F.col("_n") > 1)).drop("_n")
