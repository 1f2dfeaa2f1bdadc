"""Declarative data contracts and typed configuration, kept as YAML."""

from __future__ import annotations

import logging
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

import yaml

log = logging.getLogger(__name__)


@dataclass
class DataContract:
    name: str
    version: str = "1.0.0"
    owner: str = ""
    description: str = ""
    consumers: list[str] = field(default_factory=list)
    schema: dict[str, dict[str, Any]] = field(default_factory=dict)
    rules: list[dict[str, str]] = field(default_factory=list)
    sla: dict[str, Any] = field(default_factory=lambda: {"freshness_hours": 24, "min_dq_score": 85})

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_yaml(cls, path: str | Path) -> DataContract:
        data = yaml.safe_load(Path(path).read_text()) or {}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    def save_yaml(self, folder: str | Path) -> Path:
        path = Path(folder) / f"{self.name}_v{self.version}.yaml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))
        return path


class ContractRegistry:
    """Contracts by name; of several versions the one registered last counts."""

    def __init__(self, folder: str | None = None):
        self.folder = Path(folder) if folder else None
        self.contracts: dict[str, DataContract] = {}
        for path in sorted(self.folder.glob("*.yaml")) if self.folder and self.folder.exists() else ():
            try:
                contract = DataContract.from_yaml(path)
                self.contracts[contract.name] = contract
            except (yaml.YAMLError, TypeError) as e:
                log.warning("skipped %s: %s", path, e)

    def register(self, contract: DataContract) -> None:
        self.contracts[contract.name] = contract
        if self.folder:
            contract.save_yaml(self.folder)

    def get(self, name: str) -> DataContract | None:
        return self.contracts.get(name)

    def list_all(self) -> list[DataContract]:
        return list(self.contracts.values())

    def get_consumers(self, name: str) -> list[str]:
        return list(self.contracts[name].consumers) if name in self.contracts else []


@dataclass
class SparkConfig:
    app_name: str = "tessera"
    master: str | None = None
    shuffle_partitions: int | None = None


@dataclass
class PathConfig:
    bronze: str = "data/bronze"
    silver: str = "data/silver"
    gold: str = "data/gold"
    quarantine: str = "data/quarantine"
    streaming: str = "data/streaming"


@dataclass
class QualityConfig:
    default_threshold: float = 85.0
    sensitivity: float = 1.5
    window: int = 20


@dataclass
class Config:
    spark: SparkConfig = field(default_factory=SparkConfig)
    paths: PathConfig = field(default_factory=PathConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)


def load_raw_config(path: str) -> dict[str, Any]:
    file = Path(path)
    return (yaml.safe_load(file.read_text()) or {}) if file.exists() else {}


def load_config(path: str) -> Config:
    """Typed settings; a missing file or section means defaults, unknown keys are left out."""
    raw, out = load_raw_config(path), Config()
    for f in fields(Config):
        part = getattr(out, f.name)
        if is_dataclass(part):
            for k, v in (raw.get(f.name) or {}).items():
                if hasattr(part, k):
                    setattr(part, k, v)
    return out
