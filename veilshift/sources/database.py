"""Databases: schema and keys from their catalogs, reads in key ranges, additive DDL, and upserts in transactions.

Metadata, DDL and writes go through `connect`, a function that gives a DB-API connection wherever it is called; it is
sent to executors. Rows are read by Spark's JDBC reader where a URL is given, else through `connect` too, a task for
each range of the key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import Column, ConnectorError, ForeignKey, Kind, Schema, Table, TableRef
from ..operators import upsert as U
from ..plans import dialects as D
from .types import spark_of, to_canonical

# What each engine's catalog is asked. Columns: namespace, table, column, native type, length, precision,
# scale, nullable. Keys: namespace, table, column. Links: child's namespace, table, column, parent's, constraint.
_STANDARD_KEYS = """SELECT k.table_schema, k.table_name, k.column_name FROM information_schema.table_constraints c
JOIN information_schema.key_column_usage k ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name
WHERE c.constraint_type = 'PRIMARY KEY' ORDER BY k.table_schema, k.table_name, k.ordinal_position"""
_STANDARD_LINKS = """SELECT a.table_schema, a.table_name, a.column_name, b.table_schema, b.table_name, b.column_name, a.constraint_name FROM information_schema.referential_constraints r
JOIN information_schema.key_column_usage a ON a.constraint_schema = r.constraint_schema AND a.constraint_name = r.constraint_name
JOIN information_schema.key_column_usage b ON b.constraint_schema = r.unique_constraint_schema AND b.constraint_name = r.unique_constraint_name AND b.ordinal_position = {position}
ORDER BY a.table_schema, a.table_name, a.constraint_name, a.ordinal_position"""
_STANDARD_COLUMNS = """SELECT table_schema, table_name, column_name, {type}, character_maximum_length, numeric_precision, numeric_scale, is_nullable
FROM information_schema.columns ORDER BY table_schema, table_name, ordinal_position"""
CATALOGS = {
    "postgres": (_STANDARD_COLUMNS.format(type="udt_name"), _STANDARD_KEYS, _STANDARD_LINKS.format(position="a.position_in_unique_constraint")),
    "sqlserver": (_STANDARD_COLUMNS.format(type="data_type"), _STANDARD_KEYS, _STANDARD_LINKS.format(position="a.ordinal_position")),
    "mysql": (
        _STANDARD_COLUMNS.format(type="data_type"), _STANDARD_KEYS,
        """SELECT table_schema, table_name, column_name, referenced_table_schema, referenced_table_name, referenced_column_name, constraint_name FROM information_schema.key_column_usage
WHERE referenced_table_name IS NOT NULL ORDER BY table_schema, table_name, constraint_name, ordinal_position""",
    ),
    "oracle": (
        "SELECT owner, table_name, column_name, data_type, char_length, data_precision, data_scale, nullable FROM all_tab_columns ORDER BY owner, table_name, column_id",
        """SELECT k.owner, k.table_name, k.column_name FROM all_constraints c JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name
WHERE c.constraint_type = 'P' ORDER BY k.owner, k.table_name, k.position""",
        """SELECT a.owner, a.table_name, a.column_name, b.owner, b.table_name, b.column_name, a.constraint_name FROM all_constraints c
JOIN all_cons_columns a ON a.owner = c.owner AND a.constraint_name = c.constraint_name
JOIN all_cons_columns b ON b.owner = c.r_owner AND b.constraint_name = c.r_constraint_name AND b.position = a.position
WHERE c.constraint_type = 'R' ORDER BY a.owner, a.table_name, a.constraint_name, a.position""",
    ),
}
SYSTEM = {"information_schema", "pg_catalog", "sys", "mysql", "performance_schema", "system", "xdb", "mdsys", "ctxsys"}
#: Said first in a transaction whose constraints are checked at its end.
DEFER = {"postgres": "SET CONSTRAINTS ALL DEFERRED", "oracle": "SET CONSTRAINTS ALL DEFERRED"}
WHOLE = (Kind.INTEGER, Kind.LONG)


def schema_of(engine: str, columns, keys, links, wanted: tuple[str, ...] = ()) -> Schema:
    """A catalog's rows as a schema. wanted: namespaces; none: all but the system's. Only strings have a length, only
    decimals precision and scale."""
    inside = lambda s: s in wanted if wanted else (s or "").lower() not in SYSTEM
    key_of: dict[TableRef, list[str]] = {}
    for s, t, c in keys:
        key_of.setdefault(TableRef(t, s), []).append(c)
    tables: dict[TableRef, list[Column]] = {}
    for s, t, c, native, length, precision, scale, nullable in columns:
        if inside(s):
            ref = TableRef(t, s)
            kind = to_canonical(engine, native, length, precision, scale)
            sizes = (kind.length if kind.kind is Kind.STRING else None, *((kind.precision, kind.scale) if kind.kind is Kind.DECIMAL else (None, None)))
            own = c in key_of.get(ref, ())
            tables.setdefault(ref, []).append(Column(c, type(kind)(kind.kind, *sizes), str(nullable).upper() in ("YES", "Y", "1", "TRUE") and not own, own))
    by_name: dict[tuple, list[tuple[str, str]]] = {}
    for s, t, c, ps, pt, pc, name in links:
        if inside(s) and inside(ps):
            by_name.setdefault((TableRef(t, s), TableRef(pt, ps), name), []).append((c, pc))
    keys_found = tuple(ForeignKey(a, tuple(c for c, _ in x), b, tuple(p for _, p in x)) for (a, b, _), x in by_name.items())
    return Schema(tuple(Table(r, tuple(c), tuple(key_of.get(r, ()))) for r, c in tables.items()), keys_found)


def key_ranges(low, high, parts: int) -> list[tuple]:
    """(from, to) of ranges of a whole-number key that cover low to high, `to` not included; one open range without bounds."""
    if low is None or high is None:
        return [(None, None)]
    step = max(1, -(-(high - low + 1) // parts))
    return [(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]


def _execute(con, sql: str, args=()) -> list[tuple]:
    cursor = con.cursor()
    cursor.execute(sql, args)
    return [tuple(r) for r in cursor.fetchall()] if cursor.description else []


def _send(con, engine: str, ref: TableRef, key: list[str], names: list[str], rows: list[tuple]) -> U.Upserted:
    """One batch in the open transaction: how many of its keys were new, how many there."""
    at = [names.index(k) for k in key]
    known = [tuple(r[i] for i in at) for r in rows]
    whole = [k for k in known if None not in k]
    there = 0
    one = "(" + " AND ".join(f"{D.quote(engine, k)} = ?" for k in key) + ")"
    for a in range(0, len(whole), 100):
        some = whole[a : a + 100]
        there += _execute(con, f"SELECT count(*) FROM {D.qualified(engine, ref)} WHERE {' OR '.join([one] * len(some))}", [v for k in some for v in k])[0][0]
    con.cursor().executemany(D.upsert_sql(engine, ref, key, names), rows)
    return U.Upserted(len(rows) - there, there)


@dataclass
class Database:
    """url and options: of Spark's JDBC reader. schemas: the namespaces that count."""

    url: str = ""
    options: dict = field(default_factory=dict)
    connect: Callable | None = None
    schemas: tuple[str, ...] = ()
    partitions: int = 32
    batch: int = 5000
    engine = ""
    deferred_constraints = False

    def _ask(self, spark: SparkSession, sql: str) -> list[tuple]:
        """A metadata query's rows."""
        if self.connect is None:
            return [tuple(r) for r in spark.read.format("jdbc").options(url=self.url, query=sql, **self.options).load().collect()]
        con = self.connect()
        try:
            return _execute(con, sql)
        finally:
            con.close()

    def test(self, spark: SparkSession) -> bool:
        return bool(self._ask(spark, "SELECT 1 AS one FROM dual" if self.engine == "oracle" else "SELECT 1 AS one"))

    def schema(self, spark: SparkSession) -> Schema:
        return schema_of(self.engine, *(self._ask(spark, q) for q in CATALOGS[self.engine]), self.schemas)

    def _bounds(self, spark: SparkSession, table: Table) -> tuple:
        """The first key column and its least and greatest value, if they are whole numbers."""
        key = table.column(table.key[0]) if table.key else None
        if key is None or key.type.kind not in WHOLE:
            return None, None, None
        q = D.quote(self.engine, key.name)
        return key.name, *self._ask(spark, f"SELECT min({q}), max({q}) FROM {D.qualified(self.engine, table.ref)}")[0]

    def read(self, spark: SparkSession, ref: TableRef) -> DataFrame:
        """A table, a task for each range of its key; without a key of whole numbers it is one task."""
        table = self.schema(spark).table(ref)
        if table is None:
            raise ConnectorError(f"there is no table {ref.name}")
        column, low, high = self._bounds(spark, table)
        if self.connect is None:
            reader = spark.read.format("jdbc").options(url=self.url, dbtable=D.qualified(self.engine, ref), **self.options)
            if column and low is not None:
                reader = reader.options(partitionColumn=D.quote(self.engine, column), lowerBound=low, upperBound=high + 1, numPartitions=self.partitions)
            return reader.load()
        ranges = key_ranges(low, high, self.partitions) if column else [(None, None)]
        connect, size = self.connect, self.batch
        names = ", ".join(D.quote(self.engine, c.name) for c in table.columns)
        sql, on = f"SELECT {names} FROM {D.qualified(self.engine, ref)}", D.quote(self.engine, column) if column else ""
        kinds = T.StructType([T.StructField(c.name, spark_of(c.type)) for c in table.columns])
        arrow = to_arrow_schema(kinds)

        def fetch(batches):
            for batch in batches:
                for low, high in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                    con = connect()
                    try:
                        cursor = con.cursor()
                        cursor.execute(*((sql,) if low is None else (f"{sql} WHERE {on} >= ? AND {on} < ?", (low, high))))
                        while rows := cursor.fetchmany(size):
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]).cast(f.type) for k, f in enumerate(arrow)], schema=arrow)
                    finally:
                        con.close()

        given = spark.createDataFrame([Row(low=a, high=b) for a, b in ranges], "low bigint, high bigint").repartitionByRange(len(ranges), "low")
        return given.mapInArrow(fetch, kinds)

    def apply(self, actions) -> list[str]:
        """Run a diff's statements, each by itself; what failed, by its first line."""
        failed = []
        if not actions:
            return failed
        if self.connect is None:
            raise ConnectorError("changing a schema needs a connection")
        con = self.connect()
        try:
            for sql in D.ddl(self.engine, actions):
                try:
                    con.cursor().execute(sql)
                    con.commit()
                except Exception as e:  # the tables that need it fail by themselves later
                    con.rollback()
                    failed.append(f"{sql.split('(')[0].strip()}: {str(e).splitlines()[0][:200] if str(e) else type(e).__name__}")
        finally:
            con.close()
        return failed

    def upsert(self, df: DataFrame, ref: TableRef, key: list[str], order: list[str] | None = None) -> U.Upserted:
        """Batches of rows, each a transaction; a batch that is sent again after a lost executor counts as updates."""
        if self.connect is None:
            raise ConnectorError("an upsert needs a connection")
        rows = U.last_of_each(df, key, order)
        connect, engine, size, names = self.connect, self.engine, self.batch, rows.columns

        def send(batches):
            total, con = U.Upserted(0, 0), None
            try:
                for batch in batches:
                    for a in range(0, batch.num_rows, size):
                        con = con or connect()
                        some = batch.slice(a, size)
                        held = list(zip(*(some.column(k).to_pylist() for k in range(some.num_columns)), strict=True))
                        try:
                            total += _send(con, engine, ref, key, names, held)
                            con.commit()
                        except Exception:
                            con.rollback()
                            raise
            finally:
                if con is not None:
                    con.close()
            yield pa.RecordBatch.from_arrays([pa.array([total.inserted]), pa.array([total.updated])], ["inserted", "updated"])

        got = rows.mapInArrow(send, "inserted bigint, updated bigint").agg(F.sum("inserted"), F.sum("updated")).first()
        return U.Upserted(got[0] or 0, got[1] or 0)

    def upsert_together(self, tables: list[tuple[DataFrame, TableRef, list[str], list[str] | None]]) -> list[U.Upserted]:
        """Tables of a cycle in one transaction, constraints checked at its end; so all rows pass one connection, in batches."""
        con, done = self.connect(), []
        try:
            if self.engine in DEFER:
                con.cursor().execute(DEFER[self.engine])
            for df, ref, key, order in tables:
                rows, total, held = U.last_of_each(df, key, order), U.Upserted(0, 0), []
                for r in rows.toLocalIterator():
                    held.append(tuple(r))
                    if len(held) == self.batch:
                        total, held = total + _send(con, self.engine, ref, key, rows.columns, held), []
                if held:
                    total += _send(con, self.engine, ref, key, rows.columns, held)
                done.append(total)
            con.commit()
            return done
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()
