"""Control data: cached plans, audit tables, reports, and keeping secrets out of logs."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict, is_dataclass
from datetime import UTC, datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ColumnPlan, MaskingRule, Plan, Source, TablePlan, TableRef
from ..operators.diff import Diff


def _plain(x):
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, TableRef):
        return x.name
    if is_dataclass(x):
        return {k: _plain(getattr(x, k)) for k in x.__dataclass_fields__}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set | frozenset):
        return [_plain(v) for v in x]
    return x


def plan_to_json(plan: Plan) -> str:
    def of(t: TablePlan) -> dict:
        return {"source": asdict(t.source), "destination": asdict(t.destination), "natural_key": t.natural_key, "load_order": t.load_order, "depends_on": [asdict(r) for r in t.depends_on], "columns": [_plain(c) for c in t.columns]}

    return json.dumps({"fingerprint": plan.fingerprint, "generated_at": plan.generated_at, "tables": [of(t) for t in plan.tables]}, indent=1)


def plan_from_json(text: str) -> Plan:
    x = json.loads(text)

    def column(c) -> ColumnPlan:
        return ColumnPlan(c["source"], c["destination"], c["sensitive"], MaskingRule(**c["masking"]) if c["masking"] else None, c["confidence"], Source(c["decision"]), tuple(c["basis"]))

    tables = [TablePlan(TableRef(**t["source"]), TableRef(**t["destination"]), tuple(t["natural_key"]), tuple(column(c) for c in t["columns"]), t["load_order"], tuple(TableRef(**r) for r in t["depends_on"])) for t in x["tables"]]
    return Plan(x["fingerprint"], x["generated_at"], tuple(tables))


class PlanCache:
    """A file for each plan, by its cache key."""

    def __init__(self, folder: str):
        self.folder = os.path.join(folder, "plans")

    def _path(self, key: str) -> str:
        return os.path.join(self.folder, key.replace(":", "-") + ".json")

    def find(self, key: str) -> Plan | None:
        if not os.path.exists(self._path(key)):
            return None
        with open(self._path(key)) as f:
            return plan_from_json(f.read())

    def save(self, key: str, plan: Plan) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self._path(key) + ".new", "w") as f:
            f.write(plan_to_json(plan))
        os.replace(self._path(key) + ".new", self._path(key))


#: Audit tables and their columns.
AUDIT = {
    "audit_run": "run_id string, event string, at string, mode string, outcome string, fingerprint string",
    "audit_table_result": "run_id string, source_table string, destination_table string, inserted bigint, updated bigint, outcome string, error string",
    "audit_column_masking": "run_id string, table_name string, column_name string, technique string, confidence double, decision_source string, regulatory_basis string",
    "audit_ddl_conflict": "run_id string, table_name string, column_name string, expected string, found string, reason string",
}


class Audit:
    """Append-only Parquet tables; values of rows never get there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _add(self, table: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, AUDIT[table]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(AUDIT[table]).parquet(f"{self.folder}/{table}")

    def run_started(self, run: str, mode: str, fingerprint: str) -> None:
        self._add("audit_run", [(run, "start", datetime.now(UTC).isoformat(), mode, None, fingerprint)])

    def run_ended(self, run: str, mode: str, outcome: str, fingerprint: str) -> None:
        self._add("audit_run", [(run, "end", datetime.now(UTC).isoformat(), mode, outcome, fingerprint)])

    def latest(self) -> DataFrame:
        """The state of each run: its end if there is one, else its start."""
        return self.read("audit_run").groupBy("run_id").agg(F.max_by(F.struct("event", "at", "mode", "outcome", "fingerprint"), F.struct(F.col("event") == "end", "at")).alias("x")).select("run_id", "x.*")

    def table_result(self, run: str, plan: TablePlan, outcome) -> None:
        self._add("audit_table_result", [(run, plan.source.name, plan.destination.name, outcome.inserted, outcome.updated, outcome.status, outcome.error)])

    def plan(self, run: str, plan: Plan, found: Diff) -> None:
        self._add("audit_column_masking", [(run, t.source.name, c.source, c.masking.technique, float(c.confidence), c.decision.value, ",".join(c.basis)) for t in plan.tables for c in t.columns if c.sensitive])
        self._add("audit_ddl_conflict", [(run, c.table.name, c.column, c.expected, c.found, c.reason) for c in found.conflicts])


def masked_for(audit: DataFrame, basis: str) -> DataFrame:
    """Columns that were masked because of a regulation; the basis is matched as a whole tag."""
    return audit.filter(F.array_contains(F.split("regulatory_basis", ","), basis))


#: Columns of a plan's report.
REPORT = ("step", "table", "column", "becomes", "treatment", "because")


def report_rows(plan: Plan, found: Diff) -> list[tuple]:
    """REPORT: a row for each planned column in load order, then for each change and each obstacle at the destination."""
    out = []
    for t in sorted(plan.tables, key=lambda t: (t.load_order, t.source.name)):
        for c in t.columns:
            how = c.masking.technique if c.sensitive else "as it is"
            why = " ".join([f"{c.decision.value} {c.confidence:.2f}", *c.basis]) if c.sensitive else ""
            key = " (key)" if c.source in t.natural_key else ""
            out.append((str(t.load_order), t.source.name, c.source + key, f"{t.destination.name}.{c.destination}", how, why))
    for a in found.actions:
        where = a.schema if a.type == "CREATE_SCHEMA" else a.table.name
        out.append(("change", where, a.column.name if a.column else "", "", a.type, ""))
    for c in found.conflicts:
        out.append(("obstacle", c.table.name, c.column, "", f"is {c.found}, not {c.expected}", c.reason))
    return out


def report_text(plan: Plan, found: Diff) -> str:
    """The rows as a table of text, under what the plan was made of."""
    rows = [REPORT, *report_rows(plan, found)]
    wide = [max(len(r[k]) for r in rows) for k in range(len(REPORT))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in rows]
    after = [f"{t.source.name} loads after {', '.join(r.name for r in t.depends_on)}" for t in plan.tables if t.depends_on]
    return "\n".join([f"plan of {plan.generated_at} for schema {plan.fingerprint}", "", *lines, "", *after]).rstrip() + "\n"


def report_json(plan: Plan, found: Diff) -> str:
    return json.dumps({"plan": _plain(plan), "ddlDiff": _plain(found)}, indent=2)


def write_report(plan: Plan, found: Diff, folder: str | None = None, name: str = "plan") -> str:
    """The text, which is also what a console shows; with a folder, name.txt and name.json there."""
    text = report_text(plan, found)
    if folder:
        os.makedirs(folder, exist_ok=True)
        for end, what in (("txt", text), ("json", report_json(plan, found))):
            with open(os.path.join(folder, f"{name}.{end}"), "w") as f:
                f.write(what)
    return text


class SecretFilter(logging.Filter):
    """Blanks secrets in log records."""

    def __init__(self, *secrets: str):
        super().__init__()
        self.secrets = [s for s in secrets if s]

    def filter(self, record: logging.LogRecord) -> bool:
        text = record.getMessage()
        for s in self.secrets:
            text = text.replace(s, "***")
        record.msg, record.args = text, ()
        return True
