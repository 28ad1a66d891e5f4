import functools
import os
import sqlite3
import sys

import pytest
from pyspark import cloudpickle

from veilshift.model import CanonicalType, Column, ConnectorError, ForeignKey, Kind, MaskingRule, Table, TableRef
from veilshift.operators import diff as D
from veilshift.operators import upsert as U
from veilshift.operators.graph import CycleRule
from veilshift.plans import runner
from veilshift.plans.config import Override, Settings
from veilshift.sources import connectors
from veilshift.sources.database import key_ranges


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


class Cursor:
    """A cursor that speaks the other engine's words where SQLite has its own."""

    def __init__(self, real):
        self.real = real

    def execute(self, sql, args=()):
        if sql == "SET CONSTRAINTS ALL DEFERRED":
            self.real.execute("BEGIN")  # it holds to the end of a transaction
            sql = "PRAGMA defer_foreign_keys = ON"
        if sql.startswith("CREATE SCHEMA"):
            return None
        return self.real.execute(sql, args)

    def __getattr__(self, name):
        return getattr(self.real, name)


class Connection:
    def __init__(self, real):
        self.real = real

    def cursor(self):
        return Cursor(self.real.cursor())

    def __getattr__(self, name):
        return getattr(self.real, name)


def connect(path):
    """A database file as schema `app`, with a catalog like the standard's made from its own."""
    con = sqlite3.connect(":memory:", timeout=60, isolation_level=None)
    con.execute("ATTACH ? AS app", (path,))
    con.execute("PRAGMA foreign_keys = ON")
    con.execute("ATTACH ':memory:' AS information_schema")
    c = con.cursor()
    c.execute("CREATE TABLE information_schema.columns (table_schema, table_name, column_name, udt_name, character_maximum_length, numeric_precision, numeric_scale, is_nullable, ordinal_position)")
    c.execute("CREATE TABLE information_schema.table_constraints (constraint_schema, constraint_name, table_name, constraint_type)")
    c.execute("CREATE TABLE information_schema.key_column_usage (constraint_schema, constraint_name, table_schema, table_name, column_name, ordinal_position, position_in_unique_constraint)")
    c.execute("CREATE TABLE information_schema.referential_constraints (constraint_schema, constraint_name, unique_constraint_schema, unique_constraint_name)")
    names = {"bigint": "int8", "integer": "int4", "text": "text", "varchar": "varchar", "boolean": "bool"}
    for (t,) in c.execute("SELECT name FROM app.sqlite_master WHERE type = 'table'").fetchall():
        key = []
        for i, name, kind, required, _, pk in c.execute(f"SELECT * FROM pragma_table_info('{t}', 'app')").fetchall():
            base, _, length = kind.partition("(")
            c.execute("INSERT INTO information_schema.columns VALUES ('app', ?, ?, ?, ?, 64, 0, ?, ?)", (t, name, names[base.lower()], int(length[:-1]) if length else None, "NO" if required else "YES", i))
            if pk:
                key.append((pk, name))
        if key:
            c.execute("INSERT INTO information_schema.table_constraints VALUES ('app', ?, ?, 'PRIMARY KEY')", (f"pk_{t}", t))
        for k, name in key:
            c.execute("INSERT INTO information_schema.key_column_usage VALUES ('app', ?, 'app', ?, ?, ?, NULL)", (f"pk_{t}", t, name, k))
        for n, seq, parent, a, b, *_ in c.execute(f"SELECT * FROM pragma_foreign_key_list('{t}', 'app')").fetchall():
            c.execute("INSERT INTO information_schema.key_column_usage VALUES ('app', ?, 'app', ?, ?, ?, ?)", (f"fk_{t}_{n}", t, a, seq + 1, seq + 1))
            c.execute("INSERT INTO information_schema.referential_constraints VALUES ('app', ?, 'app', ?)", (f"fk_{t}_{n}", f"pk_{parent}"))
    con.isolation_level = "DEFERRED"
    return Connection(con)


def database(tmp_path, name, *statements):
    path = f"{tmp_path}/{name}.db"
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode = WAL")
    for s in statements:
        con.execute(s)
    con.commit()
    con.close()
    return path, connectors.source("postgres")(connect=functools.partial(connect, path), partitions=4, batch=7)


def contents(path, table):
    con = sqlite3.connect(path)
    try:
        return sorted(con.execute(f"SELECT * FROM {table}").fetchall(), key=repr)
    finally:
        con.close()


PEOPLE = "CREATE TABLE people (id bigint NOT NULL PRIMARY KEY, external_id varchar(64) UNIQUE, ssn text)"
VISITS = "CREATE TABLE visits (id bigint NOT NULL PRIMARY KEY, person bigint REFERENCES people(id), note text)"


def test_catalog_and_ranges(spark, tmp_path):
    _, db = database(tmp_path, "a", PEOPLE, VISITS, *[f"INSERT INTO people VALUES ({i * 7 - 20}, 'e{i}', NULL)" for i in range(50)])
    assert db.test(spark)
    schema = db.schema(spark)
    people = schema.table(TableRef("people", "app"))
    assert people.key == ("id",) and [(c.name, c.type.kind.value, c.type.length, c.nullable) for c in people.columns] == [("id", "LONG", None, False), ("external_id", "STRING", 64, True), ("ssn", "TEXT", None, True)]
    assert schema.foreign_keys == (ForeignKey(TableRef("visits", "app"), ("person",), TableRef("people", "app"), ("id",)),)
    df = db.read(spark, TableRef("people", "app"))
    assert sorted(r.id for r in df.collect()) == [i * 7 - 20 for i in range(50)] and df.rdd.getNumPartitions() == 4
    assert db.read(spark, TableRef("visits", "app")).count() == 0
    assert key_ranges(1, 10, 3) == [(1, 5), (5, 9), (9, 11)] and key_ranges(None, None, 3) == [(None, None)] and key_ranges(5, 5, 8) == [(5, 6)]
    with pytest.raises(ConnectorError):
        db.read(spark, TableRef("nothing", "app"))


def test_run_between_databases(spark, tmp_path):
    rows = [f"INSERT INTO people VALUES ({i}, 'ext-{i}', '{i:03}-{i % 100:02}-{i:04}')" for i in range(1, 41)]
    rows += [f"INSERT INTO visits VALUES ({i}, {i % 40 + 1}, 'n{i}')" for i in range(60)]
    _, source = database(tmp_path, "s", PEOPLE, VISITS, *rows)
    path, target = database(tmp_path, "t", "CREATE TABLE people (id varchar(64) NOT NULL PRIMARY KEY, external_id varchar(64))")
    settings = Settings(overrides={"people": Override({"ssn": MaskingRule("REDACT_FULL")}, sensitive=("id", "ssn"))})
    first = runner.run(spark, source, target, settings, b"k")
    assert first.outcome == runner.SUCCESS, (first.error, first.tables)
    assert {t.table: (o.inserted, o.updated) for t, o in first.tables.items()} == {"people": (40, 0), "visits": (60, 0)}
    assert {a.type for a in first.diff.actions} == {"CREATE_TABLE", "ADD_COLUMN"}  # visits, and people.ssn
    people, visits = contents(path, "people"), contents(path, "visits")
    assert len(people) == 40 and len(visits) == 60 and {v[1] for v in visits} <= {p[0] for p in people} and all(len(p[0]) == 43 for p in people)
    again = runner.run(spark, source, target, settings, b"k")
    assert {t.table: (o.inserted, o.updated) for t, o in again.tables.items()} == {"people": (0, 40), "visits": (0, 60)}
    assert contents(path, "people") == people and contents(path, "visits") == visits


def test_upsert_by_a_key_that_is_not_the_primary(spark, tmp_path):
    path, db = database(tmp_path, "u", "CREATE TABLE customers (id bigint, external_id varchar(64) NOT NULL PRIMARY KEY, email text)", "INSERT INTO customers VALUES (1, 'ext-1', 'a')")
    df = spark.createDataFrame([(999, "ext-999", "z@example.com"), (2, "ext-1", "b")], "id bigint, external_id string, email string")
    ref = TableRef("customers", "app")
    assert db.upsert(df, ref, ["external_id"]) == U.Upserted(1, 1) and db.upsert(df, ref, ["external_id"]) == U.Upserted(0, 2)
    assert contents(path, "customers") == [(2, "ext-1", "b"), (999, "ext-999", "z@example.com")]
    assert db.upsert(df.limit(0), ref, ["external_id"]) == U.Upserted(0, 0)


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path, db = database(tmp_path, "f", "CREATE TABLE t (id bigint NOT NULL PRIMARY KEY, v integer CHECK (v < 5))")
    with pytest.raises(Exception, match="CHECK"):
        db.upsert(spark.createDataFrame([(i, i) for i in range(6)], "id bigint, v int").coalesce(1), TableRef("t", "app"), ["id"])
    assert contents(path, "t") == []


def test_a_cycle_loads_in_one_transaction(spark, tmp_path):
    tables = ["CREATE TABLE a (id bigint NOT NULL PRIMARY KEY, other bigint REFERENCES b(id))", "CREATE TABLE b (id bigint NOT NULL PRIMARY KEY, other bigint REFERENCES a(id))"]
    _, source = database(tmp_path, "s", *tables, "INSERT INTO a VALUES (1, NULL), (2, NULL)", "INSERT INTO b VALUES (1, 2), (2, 1)", "UPDATE a SET other = 3 - id")
    path, target = database(tmp_path, "t", *tables)
    done = runner.run(spark, source, target, Settings(cycles=(CycleRule(("a", "b"), "DEFERRED"),), overrides={}), b"k")
    # keys of a cycle aren't masked unless something makes them sensitive
    assert done.outcome == runner.SUCCESS and {o.inserted for o in done.tables.values()} == {2}, (done.error, done.tables)
    assert contents(path, "a") == [(1, 2), (2, 1)] and contents(path, "b") == [(1, 2), (2, 1)]


def test_ddl_that_fails_is_told(spark, tmp_path):
    _, db = database(tmp_path, "d", PEOPLE)
    new = Column("ssn", CanonicalType(Kind.TEXT))
    good = Table(TableRef("fresh", "app"), (Column("id", CanonicalType(Kind.LONG), False, True),), ("id",))
    failed = db.apply((D.Action(D.ADD_COLUMN, TableRef("people", "app"), new), D.Action(D.CREATE_TABLE, good.ref, definition=good)))
    assert len(failed) == 1 and "duplicate column" in failed[0] and db.schema(spark).table(good.ref).key == ("id",)


def test_a_broken_swap_is_mended(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    U.upsert_files(df, path, ["id"])
    os.rename(path, f"{path}.old-0")  # a crash between the two renames
    files = connectors.source("parquet")(str(tmp_path), {"t": ("id",)})
    assert files.exists(spark, TableRef("t")) and files.read(spark, TableRef("t")).count() == 2
    os.makedirs(f"{path}.old-1")  # one after them
    assert U.upsert_files(df, path, ["id"]) == U.Upserted(0, 2) and sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["t.parquet"]
