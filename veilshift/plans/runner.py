"""Runs: plan, reconcile, load layer by layer, and tell what became of every table."""

from __future__ import annotations

import json
import os
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.masking import Key, hide_secrets, key_from_environment, masked_columns
from ..model import Plan, TablePlan, TableRef
from ..operators import diff as D
from ..operators import upsert as U
from ..operators.graph import Graph, build_graph, resolve_cycle
from . import control as C
from .config import Settings
from .fingerprint import cache_key, fingerprint
from .planner import Classifier, generate, sample_rates

COMPLETED, FAILED, SKIPPED = "COMPLETED", "FAILED", "SKIPPED"
SUCCESS, PARTIAL, HARD = "SUCCESS", "PARTIAL_FAILURE", "HARD_FAILURE"
EXIT = {SUCCESS: 0, PARTIAL: 1, HARD: 2}


@dataclass(frozen=True)
class Outcome:
    status: str
    inserted: int = 0
    updated: int = 0
    error: str | None = None


@dataclass
class Result:
    outcome: str
    plan: Plan | None = None
    diff: D.Diff = field(default_factory=D.Diff)
    tables: dict[TableRef, Outcome] = field(default_factory=dict)
    report: str = ""
    error: str | None = None

    @property
    def exit_code(self) -> int:
        return EXIT[self.outcome]


def get_or_generate_plan(spark: SparkSession, source, schema, settings: Settings, classifier: Classifier | None = None) -> Plan:
    """The cached plan for this schema and these settings, or a new one, which is cached."""
    cache = C.PlanCache(settings.control_dir) if settings.control_dir else None
    key = cache_key(schema, settings.planning())
    if cache and (found := cache.find(key)):
        return found
    tables = {t.ref: source.read(spark, t.ref) for t in schema.tables}
    plan = generate(schema, sample_rates(tables, schema, settings.sample_size), settings, classifier)
    if cache:
        cache.save(key, plan)
    return plan


def outcome_of(tables: dict[TableRef, Outcome], left_out) -> str:
    return PARTIAL if left_out or any(o.status != COMPLETED for o in tables.values()) else SUCCESS


class Loader:
    """Loads a plan's tables. A table that fails takes its dependents with it; others go on."""

    def __init__(self, spark: SparkSession, source, destination, key: Key, graph: Graph, settings: Settings, marker: str | None = None, primary: dict[TableRef, tuple[str, ...]] | None = None):
        """primary: the source's primary keys; of rows with one natural key the last by them stays."""
        self.primary = primary or {}
        self.spark, self.source, self.destination, self.key, self.graph, self.settings = spark, source, destination, key, graph, settings
        self.marker = marker
        self.done: dict[TableRef, Outcome] = {}
        if marker and os.path.exists(marker):
            with open(marker) as f:
                self.before = {TableRef(**json.loads(x)) for x in f}
        else:
            self.before = set()

    def _by(self, t: TablePlan) -> tuple[str, ...]:
        """Primary key columns that the natural key doesn't decide."""
        own = self.primary.get(t.source, ())
        return () if {k.lower() for k in own} <= {k.lower() for k in t.natural_key} else own

    def _rows(self, t: TablePlan):
        rows = self.source.read(self.spark, t.source)
        hide_secrets(self.spark)
        return rows.select(*masked_columns(rows.schema, t, self.key), *[F.col(f"`{c}`").alias(f"{U.ORDER}{i}") for i, c in enumerate(self._by(t))])

    def _order(self, t: TablePlan) -> list[str] | None:
        """The last in the source's primary-key order wins, whatever the masked values are."""
        return [f"{U.ORDER}{i}" for i in range(len(self._by(t)))] or None

    def _mark(self, t: TableRef, o: Outcome) -> None:
        self.done[t] = o
        if self.marker and o.status == COMPLETED:
            with open(self.marker, "a") as f:
                f.write(json.dumps({"table": t.table, "schema": t.schema, "catalog": t.catalog}) + "\n")

    def _blocked(self, t: TablePlan, inside=frozenset()) -> str | None:
        bad = [p.name for p in t.depends_on if p not in inside and self.done.get(p, Outcome(COMPLETED)).status != COMPLETED]
        return f"parent {bad[0]} isn't available" if bad else None

    def load(self, t: TablePlan) -> Outcome:
        if t.source in self.before:
            return Outcome(COMPLETED)
        if why := self._blocked(t):
            return Outcome(SKIPPED, error=why)
        try:
            n = self.destination.upsert(self._rows(t), t.destination, list(t.destination_key), self._order(t))
            return Outcome(COMPLETED, n.inserted, n.updated)
        except Exception as e:  # a table's failure is its outcome
            return Outcome(FAILED, error=str(e).splitlines()[0][:500] if str(e) else type(e).__name__)

    def load_cycle(self, group: list[TablePlan]) -> None:
        capable = getattr(self.destination, "deferred_constraints", False)
        by_ref = {t.source: t for t in group}
        strategy, order = resolve_cycle(frozenset(by_ref), self.settings.cycles, capable)
        if strategy == "UNSUPPORTED":
            for t in group:
                self._mark(t.source, Outcome(FAILED, error="its cycle has no load strategy"))
            return
        if strategy == "DECLARED_ORDER":
            failed = None
            for ref in order:
                if failed:
                    self._mark(ref, Outcome(SKIPPED, error=f"{failed.name} of its cycle failed"))
                    continue
                t = by_ref[ref]
                why = self._blocked(t, by_ref.keys())
                o = Outcome(SKIPPED, error=why) if why else self._alone(t, by_ref.keys())
                self._mark(ref, o)
                failed = ref if o.status != COMPLETED else None
            return
        self._together(group, by_ref)

    def _alone(self, t: TablePlan, inside) -> Outcome:
        held = {p: self.done.pop(p) for p in list(self.done) if p in inside and self.done[p].status != COMPLETED}
        try:
            return self.load(t)
        finally:
            self.done |= held

    def _together(self, group: list[TablePlan], by_ref) -> None:
        """All tables are staged before any is swapped in."""
        if why := next((w for t in group if (w := self._blocked(t, by_ref.keys()))), None):
            for t in group:
                self._mark(t.source, Outcome(SKIPPED, error=why))
            return
        staged = []
        try:
            if hasattr(self.destination, "upsert_together"):
                done = self.destination.upsert_together([(self._rows(t), t.destination, list(t.destination_key), self._order(t)) for t in group])
                for t, n in zip(group, done, strict=True):
                    self._mark(t.source, Outcome(COMPLETED, n.inserted, n.updated))
                return
            for t in group:
                path = self.destination.path(t.destination)
                staged.append((t, path, *U.stage_files(self._rows(t), path, list(t.destination_key), self.destination.format, self._order(t))))
            for _, path, fresh, _ in staged:
                if fresh:
                    U.swap(self.spark, fresh, path)
            for t, _, _, n in staged:
                self._mark(t.source, Outcome(COMPLETED, n.inserted, n.updated))
        except Exception as e:
            for t in group:
                self._mark(t.source, Outcome(FAILED, error=str(e).splitlines()[0][:500]))

    def load_all(self, plan: Plan) -> dict[TableRef, Outcome]:
        by_ref = {t.source: t for t in plan.tables}
        cycles = self.graph.cycles()
        for layer in self.graph.load_layers():
            groups = {c for c in cycles if c & set(layer)}
            plain = [by_ref[t] for t in layer if t in by_ref and not any(t in c for c in groups)]
            with ThreadPoolExecutor(self.settings.parallelism) as pool:
                for t, o in zip(plain, pool.map(self.load, plain), strict=True):
                    self._mark(t.source, o)
            for c in sorted(groups, key=lambda c: min(t.name for t in c)):
                if members := [by_ref[t] for t in sorted(c, key=lambda t: t.name) if t in by_ref]:
                    self.load_cycle(members)
        return self.done


def run(spark: SparkSession, source, destination, settings: Settings, key: bytes | None = None, classifier: Classifier | None = None, plan_only: bool = False, resume: str | None = None) -> Result:
    """resume: id of a run that was broken off; its completed tables aren't loaded again."""
    hide_secrets(spark)
    run_id = resume or uuid.uuid4().hex
    audit = C.Audit(spark, settings.control_dir) if settings.control_dir else None
    mode, print_of = "PLAN_ONLY" if plan_only else "FULL", ""
    try:
        source.test(spark)
        schema = source.schema(spark)
        print_of = fingerprint(schema)
        if audit:
            audit.run_started(run_id, mode, print_of)
        plan = get_or_generate_plan(spark, source, schema, settings, classifier)
        found = D.diff(D.desired_schema(plan, schema), destination.schema(spark))
        report = C.write_report(plan, found, settings.control_dir if plan_only else None)
        if audit:
            audit.plan(run_id, plan, found)
        if plan_only:
            result = Result(SUCCESS, plan, found, report=report)
        else:
            pads = Key.of(key if key is not None else key_from_environment(settings.key_ref))
            graph = build_graph(schema, settings.virtual_keys)
            ready, left_out = D.prune(plan, found, graph)
            for t in ready.tables:  # all of it compiles before any of it runs
                masked_columns(source.read(spark, t.source).schema, t, pads)
            marker = os.path.join(settings.control_dir, f"run-{run_id}.done") if settings.control_dir else None
            if hasattr(destination, "apply"):
                destination.apply(found.actions)
            primary = {t.ref: t.key for t in schema.tables}
            tables = Loader(spark, source, destination, pads, graph, settings, marker, primary).load_all(ready)
            tables = {**tables, **{t: Outcome(SKIPPED, error=why) for t, why in left_out.items()}}
            if audit:
                for t in ready.tables:
                    audit.table_result(run_id, t, tables[t.source])
            result = Result(outcome_of(tables, left_out), plan, found, tables, report)
    except Exception as e:
        result = Result(HARD, error=str(e).splitlines()[0][:500] if str(e) else type(e).__name__)
    if audit and print_of:
        audit.run_ended(run_id, mode, result.outcome, print_of)
    return result


def main(argv: list[str], spark: SparkSession, source, destination, settings: Settings) -> int:
    """Exit code: 0 done, 1 some tables failed or were skipped, 2 nothing could run."""
    result = run(spark, source, destination, settings, plan_only="--plan-only" in argv)
    print(result.report or result.error or "", file=sys.stdout)
    return result.exit_code
