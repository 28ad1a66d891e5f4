"""SQL text for the databases: quoting, types, additive DDL and upserts."""

from __future__ import annotations

from ..model import CanonicalType, Column, ConnectorError, Table, TableRef
from ..sources.types import from_canonical

#: Quotation marks by engine, and types that need (max) where they have no length.
QUOTES = {"postgres": '""', "oracle": '""', "mysql": "``", "sqlserver": "[]"}
UNBOUNDED = ("nvarchar", "varchar", "varbinary")


def quote(engine: str, name: str) -> str:
    if engine not in QUOTES:
        raise ConnectorError(f"{engine} has no SQL")
    begin, end = QUOTES[engine]
    return f"{begin}{name.replace(end, end * 2)}{end}"


def qualified(engine: str, ref: TableRef) -> str:
    return ".".join(quote(engine, p) for p in (ref.catalog, ref.schema, ref.table) if p and p.strip())


def type_text(engine: str, t: CanonicalType) -> str:
    name, length, precision, scale = from_canonical(engine, t)
    if precision is not None and scale is not None:
        return f"{name}({precision},{scale})"
    if length is not None:
        return f"{name}({length})"
    return f"{name}(max)" if engine == "sqlserver" and name in UNBOUNDED else name


def _definition(engine: str, c: Column) -> str:
    return f"{quote(engine, c.name)} {type_text(engine, c.type)}" + ("" if c.nullable else " NOT NULL")


def create_schema(engine: str, schema: str) -> str:
    if engine == "oracle":
        raise ConnectorError("a schema is a user account there, which isn't created by this tool")
    if engine == "sqlserver":
        name = schema.replace("'", "''")
        return f"IF NOT EXISTS (SELECT * FROM sys.schemas WHERE name = '{name}') EXEC('CREATE SCHEMA {quote(engine, schema)}')"
    return f"CREATE SCHEMA IF NOT EXISTS {quote(engine, schema)}"


def create_table(engine: str, t: Table) -> str:
    parts = [_definition(engine, c) for c in t.columns]
    if t.key:
        parts.append(f"PRIMARY KEY ({', '.join(quote(engine, k) for k in t.key)})")
    return f"CREATE TABLE {qualified(engine, t.ref)} ({', '.join(parts)})"


def add_column(engine: str, ref: TableRef, c: Column) -> str:
    what = {"oracle": f"ADD ({_definition(engine, c)})", "sqlserver": f"ADD {_definition(engine, c)}"}.get(engine, f"ADD COLUMN {_definition(engine, c)}")
    return f"ALTER TABLE {qualified(engine, ref)} {what}"


def ddl(engine: str, actions) -> list[str]:
    """Statements of a diff's actions in order; schemas are left out where they can't be created."""
    out = []
    for a in actions:
        if a.type == "CREATE_SCHEMA":
            if engine != "oracle":
                out.append(create_schema(engine, a.schema))
        else:
            out.append(create_table(engine, a.definition) if a.type == "CREATE_TABLE" else add_column(engine, a.table, a.column))
    return out


def upsert_sql(engine: str, ref: TableRef, key, columns) -> str:
    """One row's upsert with ? for every column; where all columns are key, an existing row stays as it is."""
    q = lambda c: quote(engine, c)
    table, names = qualified(engine, ref), ", ".join(map(q, columns))
    rest = [c for c in columns if c not in key]
    if engine in ("postgres", "mysql"):
        insert = f"INSERT INTO {table} ({names}) VALUES ({', '.join('?' * len(columns))})"
        if engine == "mysql":
            sets = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest) or f"{q(key[0])} = {q(key[0])}"
            return f"{insert} ON DUPLICATE KEY UPDATE {sets}"
        what = f"DO UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)}" if rest else "DO NOTHING"
        return f"{insert} ON CONFLICT ({', '.join(map(q, key))}) {what}"
    given = ", ".join(f"? AS {q(c)}" for c in columns)
    match = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in key)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    insert = f" WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"
    if engine == "oracle":
        return f"MERGE INTO {table} t USING (SELECT {given} FROM dual) s ON ({match}){update}{insert}"
    return f"MERGE INTO {table} AS t USING (SELECT {given}) AS s ({names}) ON ({match}){update}{insert};"
