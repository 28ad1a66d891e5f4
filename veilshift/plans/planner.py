"""Plan generation: which columns are sensitive, how each is masked, and in what order tables load.

Signals are the pattern rules over the head sample, a classifier's verdicts and a person's overrides; nothing takes
sensitivity away. It spreads over foreign keys, both ways, so that masked children still meet masked parents.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame

from ..functions.masking import TECHNIQUES, validate_keys
from ..functions.rules import THRESHOLD, profile
from ..model import ColumnPlan, ForeignKey, MaskingRule, Plan, PlanValidationError, Schema, Source, TablePlan, TableRef
from ..operators.graph import build_graph
from ..sources.scan import head_sample
from .config import Override, Settings
from .fingerprint import fingerprint

KEY_RULE = MaskingRule("HASH_HMAC", encoding="BASE64URL")


@dataclass(frozen=True)
class Hint:
    """A classifier's verdict on a column."""

    sensitive: bool
    confidence: float = 1.0
    technique: str | None = None
    basis: tuple[str, ...] = ()
    rename: str | None = None


class Classifier(Protocol):
    """Sees names, types and rates, never values."""

    def classify(self, schema: Schema, rates: dict[tuple[TableRef, str], float]) -> dict[tuple[TableRef, str], Hint]: ...


@dataclass(frozen=True)
class StaticClassifier:
    """Verdicts that were prepared, by table and column name."""

    hints: dict[tuple[str, str], Hint]

    def classify(self, schema, rates):
        out = {}
        for (table, column), hint in self.hints.items():
            t = next((t for t in schema.tables if table.lower() in (t.ref.name.lower(), t.ref.table.lower())), None)
            if t is None:
                raise PlanValidationError(f"the classifier names an unknown table {table}")
            out[t.ref, column] = hint
        return out


def decide(hint: Hint | None, rate: float, forced: bool, key: bool, override: MaskingRule | None, confidence: float) -> tuple[bool, MaskingRule | None, float, Source]:
    """(sensitive, rule, confidence, where from) of one column; the first that holds:

    not sensitive; a key column (hashed, whatever else was said); an override; a confident classifier; else redacted."""
    ai, rule = bool(hint and hint.sensitive), rate >= THRESHOLD
    if not (ai or rule or forced or override):
        return False, None, 1.0, Source.AI if hint else Source.RULE
    if key:
        return True, KEY_RULE, 1.0, Source.OVERRIDE_KEY
    if override:
        return True, override, 1.0, Source.OVERRIDE
    if ai and hint.confidence >= confidence and hint.technique in TECHNIQUES and hint.technique != "GENERALIZE_BUCKET":
        return True, MaskingRule(hint.technique), hint.confidence, Source.AI_AND_RULE if rule else Source.AI
    return True, MaskingRule("REDACT_FULL"), hint.confidence if ai else 1.0, Source.LOW_CONFIDENCE if ai else Source.RULE


def closure(start: set[tuple[TableRef, str]], keys: tuple[ForeignKey, ...]) -> set[tuple[TableRef, str]]:
    """All columns that foreign keys connect with these."""
    meet: dict = {}
    for f in keys:
        for a, b in zip(f.child_columns, f.parent_columns, strict=True):
            meet.setdefault((f.child, a), set()).add((f.parent, b))
            meet.setdefault((f.parent, b), set()).add((f.child, a))
    out, todo = set(start), list(start)
    while todo:
        for x in meet.get(todo.pop(), ()):
            if x not in out:
                out.add(x)
                todo.append(x)
    return out


def sample_rates(tables: dict[TableRef, DataFrame], schema: Schema, size: int) -> dict[tuple[TableRef, str], float]:
    """The strongest rule's rate on the head sample of every column that has one. A table without any key has none."""
    out: dict[tuple[TableRef, str], float] = {}
    for t in schema.tables:
        if t.key and t.ref in tables:
            for r in profile(head_sample(tables[t.ref], list(t.key), size)).collect():  # columns times rules at most
                out[t.ref, r["column"]] = max(r.rate, out.get((t.ref, r["column"]), 0.0))
    return out


def generate(schema: Schema, rates, settings: Settings, classifier: Classifier | None = None, now: str | None = None) -> Plan:
    keys = (*schema.foreign_keys, *settings.virtual_keys)
    hints = classifier.classify(schema, rates) if classifier else {}
    of = {t.ref: settings.overrides.get(t.ref.table) or settings.overrides.get(t.ref.name) or Override() for t in schema.tables}
    every = [(t, c) for t in schema.tables for c in t.columns]
    natural = {t.ref: of[t.ref].natural_key or t.key for t in schema.tables}
    if lacking := [t.ref.name for t in schema.tables if not natural[t.ref]]:
        raise PlanValidationError(f"no natural key: {', '.join(lacking)}")
    key_columns = {(t.ref, k) for t in schema.tables for k in (*t.key, *natural[t.ref])}
    key_columns |= {(f.child, c) for f in keys for c in f.child_columns} | {(f.parent, c) for f in keys for c in f.parent_columns}
    sure = {(t.ref, c.name): decide(hints.get((t.ref, c.name)), rates.get((t.ref, c.name), 0.0), c.name in of[t.ref].sensitive, (t.ref, c.name) in key_columns, of[t.ref].masking.get(c.name), settings.confidence) for t, c in every}
    for x in closure({k for k, v in sure.items() if v[0]}, keys):
        if x in sure and not sure[x][0]:
            sure[x] = (True, KEY_RULE, 1.0, Source.OVERRIDE_KEY)
    graph = build_graph(schema, settings.virtual_keys)
    order = {t: i for i, t in enumerate(graph.load_order(), 1)}
    tables = []
    for t in schema.tables:
        columns = []
        for c in t.columns:
            hint = hints.get((t.ref, c.name))
            sensitive, rule, confidence, decision = sure[t.ref, c.name]
            name = of[t.ref].renames.get(c.name) or (hint.rename if hint and hint.rename else c.name)
            columns.append(ColumnPlan(c.name, name, sensitive, rule, confidence, decision, hint.basis if hint and sensitive else ()))
        parents = tuple(sorted({f.parent for f in keys if f.child == t.ref and f.parent != t.ref}, key=lambda r: r.name))
        plan = TablePlan(t.ref, t.ref, tuple(natural[t.ref]), tuple(columns), order[t.ref], parents)
        validate_keys(plan, [c for r, c in key_columns if r == t.ref])
        tables.append(plan)
    return Plan(fingerprint(schema), now or datetime.now(UTC).isoformat(), tuple(tables))


def exclude(plan: TablePlan, columns) -> TablePlan:
    return replace(plan, columns=tuple(c for c in plan.columns if c.source not in columns))
