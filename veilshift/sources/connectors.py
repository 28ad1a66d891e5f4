"""Connectors by name and role: files (parquet, json, csv), JDBC databases, and document stores.

A connector reads a table as a DataFrame and writes one by upsert. Databases are in database.py; `mongodb` needs its
public Spark package on the class path.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Column, ConnectorError, ForeignKey, Schema, Table, TableRef
from ..operators import upsert as U
from ..operators.infer import infer
from .database import Database
from .types import canonical_of, to_canonical

_SOURCES: dict[str, type] = {}
_DESTINATIONS: dict[str, type] = {}


def register(name: str, *, source: bool = False, destination: bool = False):
    """Class decorator. Names are case-insensitive and unique in each role."""

    def add(cls):
        for on, book in ((source, _SOURCES), (destination, _DESTINATIONS)):
            if on:
                if name.lower() in book:
                    raise ConnectorError(f"two connectors are named {name}")
                book[name.lower()] = cls
        return cls

    return add


def _find(book: dict, name: str, role: str) -> type:
    if name.lower() not in book:
        raise ConnectorError(f"no {role} connector is named {name}")
    return book[name.lower()]


def source(name: str) -> type:
    return _find(_SOURCES, name, "source")


def destination(name: str) -> type:
    return _find(_DESTINATIONS, name, "destination")


@dataclass
class Files:
    """Tables as one file or folder each. keys and foreign_keys: what files can't declare."""

    root: str
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    format: str = "parquet"
    tables: tuple[str, ...] | None = None
    document: bool = False
    deferred_constraints: bool = True

    def path(self, ref: TableRef) -> str:
        return posixpath.join(self.root, f"{ref.table}.{self.format}")

    def test(self, spark: SparkSession) -> bool:
        for t in self.tables or self.keys:
            self.read(spark, TableRef(t)).limit(0).schema
        return True

    def read(self, spark: SparkSession, ref: TableRef) -> DataFrame:
        reader = spark.read.option("header", True) if self.format == "csv" else spark.read
        return reader.format(self.format).load(self.path(ref))

    def exists(self, spark: SparkSession, ref: TableRef) -> bool:
        U.recover(spark, self.path(ref))
        return U.path_exists(spark, self.path(ref))

    def schema(self, spark: SparkSession) -> Schema:
        tables = []
        for name in self.tables or tuple(self.keys):
            if not self.exists(spark, TableRef(name)):
                continue
            key = self.keys.get(name, ())
            fields = self.read(spark, TableRef(name)).schema.fields
            columns = tuple(Column(f.name, canonical_of(f.dataType), f.nullable and f.name not in key, f.name in key) for f in fields)
            tables.append(Table(TableRef(name), columns, tuple(key)))
        return Schema(tuple(tables), self.foreign_keys)

    def upsert(self, df: DataFrame, ref: TableRef, key: list[str], order: list[str] | None = None) -> U.Upserted:
        return U.upsert_files(df, self.path(ref), key, self.format, order, document=self.document)


for _name in ("parquet", "json", "csv", "orc"):
    register(_name, source=True, destination=True)(type(f"{_name.title()}Files", (Files,), {"format": _name}))


for _name in ("postgres", "mysql", "oracle", "sqlserver"):
    register(_name, source=True, destination=True)(type(_name.title(), (Database,), {"engine": _name, "deferred_constraints": _name in ("postgres", "oracle")}))


def documents_table(ref: TableRef, df: DataFrame, key: str = "_id") -> Table:
    """A collection's table: the types that most of a sample's documents have, as infer() votes."""
    text = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("j"))
    votes = {r.field: r for r in infer(text, "j").collect()}  # one row a field
    columns = [Column(c, to_canonical("mongodb", votes[c].type if c in votes and votes[c].type != "null" else "string"), c != key and (c not in votes or votes[c].nullable), c == key) for c in df.columns]
    return Table(ref, tuple(columns), (key,) if key in df.columns else ())


@register("mongodb", source=True, destination=True)
@dataclass
class Documents:
    """A document store through its public Spark package, where that is on the class path."""

    uri: str
    database: str
    collections: tuple[str, ...] = ()
    deferred_constraints: bool = False

    def test(self, spark: SparkSession) -> bool:
        for c in self.collections:
            self.read(spark, TableRef(c)).limit(1).collect()
        return True

    def schema(self, spark: SparkSession) -> Schema:
        """Every collection's fields by the vote of a sample, with `_id` as key; a collection that isn't there yet has none."""
        return Schema(tuple(documents_table(TableRef(c), self.read(spark, TableRef(c))) for c in self.collections))

    def read(self, spark: SparkSession, ref: TableRef) -> DataFrame:
        return spark.read.format("mongodb").options(**{"connection.uri": self.uri, "database": self.database, "collection": ref.table}).load()

    def upsert(self, df: DataFrame, ref: TableRef, key: list[str], order=None) -> U.Upserted:
        rows = U.last_of_each(df, key, order, null_safe=True)
        n = rows.count()
        if n:
            rows.write.format("mongodb").mode("append").options(**{"connection.uri": self.uri, "database": self.database, "collection": ref.table, "idFieldList": ",".join(key), "operationType": "replace", "upsertDocument": "true"}).save()
        return U.Upserted(n, 0)
