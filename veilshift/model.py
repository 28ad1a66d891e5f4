"""Schemas, plans and errors. All of it is metadata; rows are only ever DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum


class MigrationError(Exception):
    """Anything that goes wrong in moving tables."""


class ConfigurationError(MigrationError):
    pass


class ConnectorError(MigrationError):
    pass


class PlanValidationError(MigrationError):
    pass


class Kind(Enum):
    STRING = "STRING"
    TEXT = "TEXT"
    INTEGER = "INTEGER"
    LONG = "LONG"
    DECIMAL = "DECIMAL"
    BOOLEAN = "BOOLEAN"
    DATE = "DATE"
    TIMESTAMP = "TIMESTAMP"
    BINARY = "BINARY"
    UUID = "UUID"
    DOUBLE = "DOUBLE"  # of our own: Parquet tables hold doubles


@dataclass(frozen=True)
class CanonicalType:
    kind: Kind
    length: int | None = None
    precision: int | None = None
    scale: int | None = None


@dataclass(frozen=True)
class TableRef:
    table: str
    schema: str | None = None
    catalog: str | None = None

    @property
    def name(self) -> str:
        return ".".join(p for p in (self.catalog, self.schema, self.table) if p)

    def within(self, schema: str | None = None, catalog: str | None = None) -> TableRef:
        """The same table with missing parts from a default namespace, so that refs of any origin compare."""
        return replace(self, schema=self.schema or schema, catalog=self.catalog or catalog)


@dataclass(frozen=True)
class Column:
    name: str
    type: CanonicalType
    nullable: bool = True
    key: bool = False
    comment: str | None = None


@dataclass(frozen=True)
class Table:
    ref: TableRef
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ()
    comment: str | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class ForeignKey:
    child: TableRef
    child_columns: tuple[str, ...]
    parent: TableRef
    parent_columns: tuple[str, ...]

    def __post_init__(self):
        if not self.child_columns or len(self.child_columns) != len(self.parent_columns):
            raise PlanValidationError("a foreign key needs as many parent as child columns, one at least")


@dataclass(frozen=True)
class Schema:
    tables: tuple[Table, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()

    def table(self, ref: TableRef) -> Table | None:
        return next((t for t in self.tables if t.ref == ref), None)


class Source(Enum):
    """Where a column's decision comes from."""

    AI = "ai"
    RULE = "rule"
    AI_AND_RULE = "ai+rule"
    OVERRIDE = "override"
    OVERRIDE_KEY = "override-key-column"
    LOW_CONFIDENCE = "low-confidence-fallback"


@dataclass(frozen=True)
class MaskingRule:
    technique: str
    encoding: str | None = None
    mode: str | None = None
    keep_last: int | None = None
    granularity: str | None = None
    corpus: str | None = None


@dataclass(frozen=True)
class ColumnPlan:
    source: str
    destination: str
    sensitive: bool = False
    masking: MaskingRule | None = None
    confidence: float = 1.0
    decision: Source = Source.RULE
    basis: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.source.strip() or not self.destination.strip():
            raise PlanValidationError("a column plan needs source and destination names")
        if self.sensitive and self.masking is None:
            raise PlanValidationError(f"sensitive column {self.source} has no masking rule")


@dataclass(frozen=True)
class TablePlan:
    source: TableRef
    destination: TableRef
    natural_key: tuple[str, ...]
    columns: tuple[ColumnPlan, ...]
    load_order: int = 1
    depends_on: tuple[TableRef, ...] = ()

    def column(self, name: str) -> ColumnPlan | None:
        """By source or destination name."""
        return next((c for c in self.columns if name.lower() in (c.source.lower(), c.destination.lower())), None)

    @property
    def destination_key(self) -> tuple[str, ...]:
        """The natural key as the destination names it."""
        return tuple(c.destination if (c := self.column(k)) else k for k in self.natural_key)


@dataclass(frozen=True)
class Plan:
    fingerprint: str
    generated_at: str
    tables: tuple[TablePlan, ...] = field(default=())

    def __post_init__(self):
        if not self.fingerprint or not self.generated_at:
            raise PlanValidationError("a plan needs a fingerprint and a time")

    def for_source(self, name: str) -> TablePlan | None:
        return next((t for t in self.tables if name.lower() in (t.source.name.lower(), t.source.table.lower())), None)
