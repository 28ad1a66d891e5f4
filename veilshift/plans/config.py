"""Settings of a run, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from ..functions.masking import check_rule
from ..model import ConfigurationError, ForeignKey, MaskingRule, TableRef
from ..operators.graph import CycleRule


@dataclass(frozen=True)
class Override:
    """What a person decided for columns of a table: column -> rule, columns to mask in any case, a natural key, new names."""

    masking: dict[str, MaskingRule] = field(default_factory=dict)
    sensitive: tuple[str, ...] = ()
    natural_key: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for rule in self.masking.values():
            check_rule(rule)


@dataclass(frozen=True)
class Settings:
    key_ref: str = "env:MASKING_KEY"
    overrides: dict[str, Override] = field(default_factory=dict)
    virtual_keys: tuple[ForeignKey, ...] = ()
    cycles: tuple[CycleRule, ...] = ()
    confidence: float = 0.85
    sample_size: int = 20
    batch_size: int = 5000
    parallelism: int = 4
    control_dir: str | None = None

    def __post_init__(self):
        if not 0 <= self.confidence <= 1:
            raise ConfigurationError("the confidence threshold lies in 0 to 1")
        if min(self.sample_size, self.batch_size, self.parallelism) < 1:
            raise ConfigurationError("sizes and parallelism are 1 at least")
        if not self.key_ref.strip():
            raise ConfigurationError("a masking key reference is needed")

    def planning(self) -> dict:
        """What a plan depends on."""
        return {"overrides": self.overrides, "confidence": self.confidence, "sample": self.sample_size, "virtual": self.virtual_keys}

    @staticmethod
    def of(tree: dict) -> Settings:
        """Settings from a tree of plain values, as a file holds it. Names that mean nothing are refused."""
        known = {f.name for f in fields(Settings)}
        if odd := sorted(tree.keys() - known):
            raise ConfigurationError(f"unknown settings: {', '.join(odd)}")
        given = dict(tree)
        try:
            if "overrides" in given:
                given["overrides"] = {t: Override({c: MaskingRule(**r) for c, r in x.get("masking", {}).items()}, tuple(x.get("sensitive", ())), tuple(x.get("natural_key", ())), x.get("renames", {})) for t, x in given["overrides"].items()}
            if "virtual_keys" in given:
                given["virtual_keys"] = tuple(ForeignKey(TableRef(*reversed(x["child"].split("."))), tuple(x["child_columns"]), TableRef(*reversed(x["parent"].split("."))), tuple(x["parent_columns"])) for x in given["virtual_keys"])
            if "cycles" in given:
                given["cycles"] = tuple(CycleRule(tuple(x["tables"]), x["strategy"], tuple(x.get("load_order", ()))) for x in given["cycles"])
        except (KeyError, TypeError, AttributeError) as e:
            raise ConfigurationError(f"settings of a wrong shape: {e}") from e
        return Settings(**given)

    @staticmethod
    def load(path: str) -> Settings:
        """A file of JSON, or of YAML where that can be read here."""
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            raise ConfigurationError("the settings can't be read") from e
        try:
            if path.endswith((".yml", ".yaml")):
                import yaml

                return Settings.of(yaml.safe_load(text) or {})
            return Settings.of(json.loads(text))
        except ImportError as e:
            raise ConfigurationError("YAML can't be read here") from e
        except ValueError as e:
            raise ConfigurationError("the settings are no JSON") from e
