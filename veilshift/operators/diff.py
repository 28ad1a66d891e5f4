"""Additive schema reconciliation: what a destination lacks, what contradicts it, and the plan without the latter."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.masking import check_rule
from ..model import Column, Kind, Plan, Schema, Table, TablePlan, TableRef
from .graph import Graph

CREATE_SCHEMA, CREATE_TABLE, ADD_COLUMN = "CREATE_SCHEMA", "CREATE_TABLE", "ADD_COLUMN"


@dataclass(frozen=True)
class Action:
    type: str
    table: TableRef | None = None
    column: Column | None = None
    schema: str | None = None
    definition: Table | None = None


@dataclass(frozen=True)
class Conflict:
    table: TableRef
    column: str
    expected: str
    found: str
    reason: str = "incompatible type"


@dataclass(frozen=True)
class Diff:
    actions: tuple[Action, ...] = ()
    conflicts: tuple[Conflict, ...] = ()


def compatible(desired: Kind, existing: Kind) -> bool:
    """Kinds alone count; a long column also takes integers."""
    return desired == existing or (desired, existing) == (Kind.INTEGER, Kind.LONG)


def desired_schema(plan: Plan, source: Schema) -> Schema:
    """What the plan's rows need: planned columns under their destination names, nullable, with masked types."""
    tables = []
    for t in plan.tables:
        of = source.table(t.source)
        columns = []
        for c in t.columns:
            kind = check_rule(c.masking).output(c.masking) if c.sensitive else of.column(c.source).type
            columns.append(Column(c.destination, kind, True, c.destination in t.destination_key))
        tables.append(Table(t.destination, tuple(columns), t.destination_key))
    return Schema(tuple(tables))


def diff(desired: Schema, existing: Schema, schema: str | None = None, catalog: str | None = None) -> Diff:
    """Never drops or alters. schema, catalog: the namespace of refs that don't tell theirs."""
    there = {t.ref.within(schema, catalog): t for t in existing.tables}
    schemas, tables, columns, conflicts = [], [], [], []
    known = {r.schema for r in there}
    for t in desired.tables:
        old = there.get(t.ref.within(schema, catalog))
        if old is None:
            if t.ref.schema and t.ref.schema not in known:
                known.add(t.ref.schema)
                schemas.append(Action(CREATE_SCHEMA, schema=t.ref.schema))
            tables.append(Action(CREATE_TABLE, t.ref, definition=t))
            continue
        for c in t.columns:
            has = old.column(c.name)
            if has is None:
                columns.append(Action(ADD_COLUMN, t.ref, c))
            elif not compatible(c.type.kind, has.type.kind):
                conflicts.append(Conflict(t.ref, c.name, c.type.kind.value, has.type.kind.value))
    return Diff((*schemas, *tables, *columns), tuple(conflicts))


def without_conflicts(t: TablePlan, conflicts) -> TablePlan | None:
    """The table's plan without conflicted columns; nothing if one is in its key."""
    bad = {c.column.lower() for c in conflicts if c.table == t.destination}
    if not bad:
        return t
    if any(k.lower() in bad for k in t.destination_key):
        return None
    return replace(t, columns=tuple(c for c in t.columns if c.destination.lower() not in bad))


def prune(plan: Plan, found: Diff, graph: Graph) -> tuple[Plan, dict[TableRef, str]]:
    """The plan that can run, and why tables don't: a conflict in their key, or a parent that is left out."""
    out, skipped = [], {}
    for t in plan.tables:
        kept = without_conflicts(t, found.conflicts)
        if kept is None:
            skipped[t.source] = "conflict in a key column"
        else:
            out.append(kept)
    for t in list(skipped):
        for d in graph.dependents(t):
            skipped.setdefault(d, f"depends on {t.name}")
    return replace(plan, tables=tuple(t for t in out if t.source not in skipped)), skipped
