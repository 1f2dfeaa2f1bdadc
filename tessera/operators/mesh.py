"""Data products, global policies and their audit."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class DataProduct:
    name: str
    domain: str
    owner: str = ""
    description: str = ""
    tags: list[str] = field(default_factory=list)
    sla: dict[str, Any] = field(default_factory=dict)
    status: str = "active"


@dataclass
class GlobalPolicy:
    name: str
    policy_type: str
    severity: str = "warning"
    description: str = ""
    rules: dict[str, Any] = field(default_factory=dict)


#: The standard policies.
DEFAULT_POLICIES = [
    GlobalPolicy("pii_masking_required", "pii", "critical", "All PII is masked before Silver.", {"masking_required": True}),
    GlobalPolicy("min_data_quality", "quality", "critical", "The overall score meets the minimum.", {"min_dq_score": 85}),
    GlobalPolicy("data_freshness_sla", "freshness", "warning", "Products are refreshed within their SLA.", {"max_freshness_hours": 24}),
    GlobalPolicy("encryption_at_rest", "encryption", "critical", "Data is encrypted at rest.", {"encryption_required": True}),
    GlobalPolicy("dpdp_retention", "retention", "critical", "Retention follows the DPDP Act.", {"retention_years": 7}),
]


class Catalogue:
    """Domains, products and policies, kept as JSON beside each other."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.domains: dict[str, dict[str, Any]] = {}
        self.products: dict[str, DataProduct] = {}
        self.policies: dict[str, GlobalPolicy] = {}
        if self.path and (file := self.path / "catalogue.json").exists():
            saved = json.loads(file.read_text())
            self.domains = saved["domains"]
            self.products = {p["name"]: DataProduct(**p) for p in saved["products"]}
            self.policies = {p["name"]: GlobalPolicy(**p) for p in saved["policies"]}

    def save(self) -> None:
        if self.path:
            self.path.mkdir(parents=True, exist_ok=True)
            data = {"domains": self.domains, "products": [asdict(p) for p in self.products.values()], "policies": [asdict(p) for p in self.policies.values()]}
            (self.path / "catalogue.json").write_text(json.dumps(data, indent=2))

    def register_domain(self, name: str, owner: str = "", description: str = "") -> None:
        self.domains[name] = {"owner": owner, "description": description}
        self.save()

    def list_domains(self) -> dict[str, dict[str, Any]]:
        return dict(self.domains)

    def register_product(self, product: DataProduct) -> None:
        self.domains.setdefault(product.domain, {"owner": product.owner, "description": ""})
        self.products[product.name] = product
        self.save()

    def get_product(self, name: str) -> DataProduct | None:
        return self.products.get(name)

    def list_products(self, domain: str | None = None) -> list[DataProduct]:
        return [p for p in self.products.values() if domain in (None, p.domain)]

    def search_products(self, tag: str) -> list[DataProduct]:
        return [p for p in self.products.values() if tag.lower() in (t.lower() for t in p.tags)]

    def deprecate_product(self, name: str) -> bool:
        product = self.products.get(name)
        if product is None:
            return False
        product.status = "deprecated"
        if "deprecated" not in product.tags:
            product.tags.append("deprecated")
        self.save()
        return True

    def add_policy(self, policy: GlobalPolicy) -> None:
        self.policies[policy.name] = policy
        self.save()

    def list_policies(self) -> list[GlobalPolicy]:
        return list(self.policies.values())

    def seed_default_policies(self) -> None:
        for p in DEFAULT_POLICIES:
            self.add_policy(p)

    def policy_frame(self, spark: SparkSession) -> DataFrame:
        return policy_frame(spark, self.list_policies())


def policy_frame(spark: SparkSession, policies: list[GlobalPolicy]) -> DataFrame:
    rows = [(p.name, p.policy_type, p.severity, float(p.rules.get("min_dq_score", 85)), float(p.rules.get("max_freshness_hours", 24))) for p in policies]
    return spark.createDataFrame(rows, "policy string, policy_type string, severity string, min_dq_score double, max_freshness_hours double")


def audit_details(products: DataFrame, policies: list[GlobalPolicy]) -> DataFrame:
    """A row per product and policy; products have product, domain, dq_score, pii_masked, freshness_hours, has_encryption.

    The policies, a short list, are expanded as a literal array beside each product.
    Retention and unknown policy types pass.
    """
    items = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.policy_type).alias("policy_type"), F.lit(p.severity).alias("severity"), F.lit(float(p.rules.get("min_dq_score", 85))).alias("min_dq_score"), F.lit(float(p.rules.get("max_freshness_hours", 24))).alias("max_freshness_hours")) for p in policies]
    out = products.select("product", "domain", "dq_score", "pii_masked", "freshness_hours", "has_encryption", F.explode(F.array(*items)).alias("p")).select("*", "p.*").drop("p")
    kind = F.col("policy_type")
    passed = (
        F.when(kind == "quality", F.col("dq_score") >= F.col("min_dq_score"))
        .when(kind == "pii", F.col("pii_masked"))
        .when(kind == "encryption", F.col("has_encryption"))
        .when(kind == "freshness", F.col("freshness_hours") <= F.col("max_freshness_hours"))
        .otherwise(F.lit(True))
    )
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def audit_products(products: DataFrame, policies: list[GlobalPolicy]) -> DataFrame:
    """Per product: policies passed and failed, critical failures, certification."""
    d = audit_details(products, policies)
    out = d.groupBy("product", "domain").agg(
        F.count("*").alias("total_policies"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("critical_failures")
    )
    return out.withColumn("certified", F.col("critical_failures") == 0)
