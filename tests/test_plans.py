import pytest

from veilshift.model import CanonicalType, Column, ColumnPlan, ConfigurationError, ConnectorError, ForeignKey, Kind, MaskingRule, Plan, PlanValidationError, Schema, Source, Table, TablePlan, TableRef
from veilshift.operators import diff as D
from veilshift.operators import graph as G
from veilshift.plans import dialects as Q
from veilshift.plans import planner as P
from veilshift.plans.config import Override, Settings
from veilshift.plans.control import SecretFilter, plan_from_json, plan_to_json, report_json, report_text
from veilshift.plans.fingerprint import cache_key, fingerprint
from veilshift.sources import types as Y

K = Kind


def table(name, *columns, key=("id",), schema=None):
    return Table(TableRef(name, schema), tuple(Column(c, CanonicalType(k), c not in key, c in key) for c, k in columns), key)


def fk(child, a, parent, b="id"):
    return ForeignKey(TableRef(child), (a,) if isinstance(a, str) else a, TableRef(parent), (b,) if isinstance(b, str) else b)


CUSTOMERS = Schema((table("customers", ("id", K.LONG), ("ssn", K.STRING), ("note", K.TEXT)),))
SSN = (TableRef("customers"), "ssn")


def column(plan, name, t=0):
    return plan.tables[t].column(name)


def test_rules_alone():
    plan = P.generate(CUSTOMERS, {SSN: 0.6}, Settings(), now="now")
    assert column(plan, "ssn").masking.technique == "REDACT_FULL" and column(plan, "ssn").decision is Source.RULE
    assert not column(plan, "note").sensitive and not column(plan, "id").sensitive and column(plan, "note").confidence == 1.0


def test_classifier_cannot_unflag_and_low_confidence_falls_back():
    hints = lambda **h: P.StaticClassifier({("customers", c): v for c, v in h.items()})
    plan = P.generate(CUSTOMERS, {SSN: 0.6}, Settings(), hints(ssn=P.Hint(False, 0.99)))
    assert column(plan, "ssn").sensitive
    plan = P.generate(CUSTOMERS, {}, Settings(), hints(note=P.Hint(True, 0.5, "HASH_HMAC")))
    assert column(plan, "note").decision is Source.LOW_CONFIDENCE and column(plan, "note").masking.technique == "REDACT_FULL"
    plan = P.generate(CUSTOMERS, {SSN: 1.0}, Settings(), hints(ssn=P.Hint(True, 0.9, "SYNTHETIC_SUBSTITUTION", ("GDPR",)), note=P.Hint(True, 0.9, None)))
    assert column(plan, "ssn").decision is Source.AI_AND_RULE and column(plan, "ssn").basis == ("GDPR",)
    assert column(plan, "note").masking.technique == "REDACT_FULL"
    with pytest.raises(PlanValidationError):
        P.generate(CUSTOMERS, {}, Settings(), P.StaticClassifier({("nowhere", "x"): P.Hint(True)}))


def test_keys_are_hashed_and_overrides_hold():
    o = {"customers": Override({"ssn": MaskingRule("REDACT_PARTIAL", keep_last=2), "id": MaskingRule("REDACT_FULL")}, renames={"ssn": "tax_id"})}
    plan = P.generate(CUSTOMERS, {}, Settings(overrides=o))
    assert column(plan, "id").masking == P.KEY_RULE and column(plan, "id").decision is Source.OVERRIDE_KEY
    assert column(plan, "tax_id").masking.keep_last == 2 and column(plan, "ssn").destination == "tax_id"
    with pytest.raises(PlanValidationError):
        Override({"x": MaskingRule("GENERALIZE_BUCKET")})
    with pytest.raises(PlanValidationError):
        P.generate(Schema((table("t", ("a", K.LONG), key=()),)), {}, Settings())
    assert P.generate(Schema((table("t", ("a", K.LONG), key=()),)), {}, Settings(overrides={"t": Override(natural_key=("a",))})).tables[0].natural_key == ("a",)


def test_sensitivity_spreads_over_foreign_keys():
    s = Schema((table("p", ("id", K.LONG), ("code", K.STRING)), table("c", ("id", K.LONG), ("p_id", K.LONG), ("p_code", K.STRING))), (fk("c", "p_id", "p"),))
    plan = P.generate(s, {(TableRef("p"), "id"): 0.9}, Settings(virtual_keys=(fk("c", "p_code", "p", "code"),)))
    assert column(plan, "p_id", 1).masking == column(plan, "id", 0).masking == P.KEY_RULE
    assert not column(plan, "p_code", 1).sensitive
    plan = P.generate(s, {(TableRef("c"), "p_code"): 0.9}, Settings(virtual_keys=(fk("c", "p_code", "p", "code"),)))
    assert column(plan, "code", 0).masking == column(plan, "p_code", 1).masking == P.KEY_RULE
    assert [t.load_order for t in plan.tables] == [1, 2] and plan.tables[1].depends_on == (TableRef("p"),)


def test_plans_and_reports():
    plan = P.generate(CUSTOMERS, {SSN: 0.6}, Settings(overrides={"customers": Override(renames={"ssn": "s"})}), now="now")
    assert plan_from_json(plan_to_json(plan)) == plan
    found = D.Diff((D.Action(D.CREATE_SCHEMA, schema="s"), D.Action(D.ADD_COLUMN, TableRef("t"), Column("x", CanonicalType(K.LONG)))), (D.Conflict(TableRef("t"), "y", "LONG", "DATE"),))
    text = report_text(plan, found)
    lines = text.splitlines()
    assert lines[0].startswith("plan of now for schema sha256:") and lines[2].split() == "step | table | column | becomes | treatment | because".split()
    assert [[v.strip() for v in x.rstrip(" |").split(" | ")] for x in lines[3:5]] == [["1", "customers", "id (key)", "customers.id", "as it is"], ["1", "customers", "ssn", "customers.s", "REDACT_FULL", "rule 1.00"]]
    assert "change" in lines[6] and "CREATE_SCHEMA" in lines[6] and "ADD_COLUMN" in lines[7] and "is DATE, not LONG | incompatible type" in lines[8]
    assert "change" not in report_text(plan, D.Diff()) and '"ddlDiff"' in report_json(plan, found)
    with pytest.raises(PlanValidationError):
        Plan("", "now")


def test_fingerprints():
    a, b = table("a", ("id", K.LONG), ("x", K.STRING)), table("b", ("id", K.LONG))
    links = (fk("b", "id", "a"), fk("b", "id", "a", "x"))
    first = fingerprint(Schema((a, b), links))
    assert first == fingerprint(Schema((b, Table(a.ref, a.columns[::-1], a.key)), links[::-1])) and first.startswith("sha256:") and len(first) == 71
    assert first != fingerprint(Schema((a, b))) and first != fingerprint(Schema((table("a", ("id", K.LONG), ("x", K.TEXT)), b), links))
    assert cache_key(CUSTOMERS, Settings().planning()) != cache_key(CUSTOMERS, Settings(confidence=0.5).planning())


def refs(*names):
    return [TableRef(n) for n in names]


def test_graph():
    g = G.build_graph(Schema((table("products", ("id", K.LONG)), table("categories", ("id", K.LONG))), (fk("order_items", "order_id", "orders"), fk("orders", "customer_id", "customers"), fk("employees", "manager_id", "employees"))))
    assert g.load_layers() == [refs("categories", "customers", "employees", "products"), refs("orders"), refs("order_items")]
    assert g.load_order()[-2:] == refs("orders", "order_items") and g.cycles() == []
    assert g.dependents(TableRef("customers")) == set(refs("orders", "order_items")) and g.dependents(TableRef("order_items")) == set()
    g = G.build_graph(Schema(()), (fk("tenants_orders", ("tenant_id", "customer_id"), "tenants_customers", ("tenant_id", "customer_id")),))
    assert g.load_order() == refs("tenants_customers", "tenants_orders")


def test_cycles():
    g = G.build_graph(Schema(()), (fk("e", "d_id", "d"), fk("d", "e_id", "e"), fk("e", "c_id", "c"), fk("x", "e_id", "e")))
    assert g.cycles() == [frozenset(refs("d", "e"))]
    assert g.load_layers() == [refs("c"), refs("d", "e"), refs("x")]  # what needs a cycle comes after it
    assert TableRef("e") in g.dependents(TableRef("e"))
    cycle = g.cycles()[0]
    assert G.resolve_cycle(cycle, (), True) == ("UNSUPPORTED", [])
    assert G.resolve_cycle(cycle, (G.CycleRule(("E", "D"), "DEFERRED"),), True)[0] == "DEFERRED"
    assert G.resolve_cycle(cycle, (G.CycleRule(("e", "d"), "DECLARED_ORDER", ("e", "D")),), False) == ("DECLARED_ORDER", refs("e", "d"))
    for rule, capable in ((G.CycleRule(("e", "d"), "DEFERRED"), False), (G.CycleRule(("e", "d"), "DECLARED_ORDER", ("e",)), True), (G.CycleRule(("e", "d"), "DECLARED_ORDER", ("e", "x")), True), (G.CycleRule(("e", "d"), "OTHER"), True)):
        with pytest.raises(ConfigurationError):
            G.resolve_cycle(cycle, (rule,), capable)
    with pytest.raises(PlanValidationError):
        ForeignKey(TableRef("a"), ("x", "y"), TableRef("b"), ("id",))


def test_diff():
    have = Schema((table("customers", ("ID", K.LONG)),))
    assert [a.type for a in D.diff(Schema((table("customers", ("id", K.LONG), ("tier", K.STRING)),)), have).actions] == [D.ADD_COLUMN]
    assert D.diff(Schema((table("customers", ("id", K.INTEGER)),)), have) == D.Diff()
    assert D.diff(Schema((table("customers", ("id", K.STRING)),)), have).conflicts[0].found == "LONG"
    new = D.diff(Schema((table("a", ("id", K.LONG), schema="r"), table("b", ("id", K.LONG), schema="r"))), have)
    assert [a.type for a in new.actions] == [D.CREATE_SCHEMA, D.CREATE_TABLE, D.CREATE_TABLE]
    # refs of different origin name the same table
    assert D.diff(Schema((table("t", ("id", K.LONG)),)), Schema((table("t", ("id", K.LONG), schema="public"),)), schema="public") == D.Diff()


def test_conflicts_prune():
    t = TablePlan(TableRef("customers"), TableRef("customers"), ("id",), (ColumnPlan("id", "id"), ColumnPlan("ssn", "tax"), ColumnPlan("tier", "tier")))
    bad = lambda c: [D.Conflict(TableRef("customers"), c, "a", "b")]
    assert D.without_conflicts(t, []) is t and D.without_conflicts(t, bad("id")) is None
    assert [c.source for c in D.without_conflicts(t, bad("TAX")).columns] == ["id", "tier"]


def test_masked_types_reach_the_destination():
    plan = P.generate(CUSTOMERS, {(TableRef("customers"), "id"): 1.0}, Settings())
    made = D.desired_schema(plan, CUSTOMERS).tables[0]
    assert made.column("id").type == CanonicalType(K.STRING, 43) and made.column("id").nullable and made.key == ("id",)
    assert made.column("note").type.kind is K.TEXT


T = table("order\"s", ("id", K.LONG), ("name", K.STRING), ("price", K.DECIMAL), schema="s")


def test_sql_text():
    ref = TableRef("t", "s")
    upsert = lambda e, cols=("id", "v"): Q.upsert_sql(e, ref, ("id",), cols)
    assert upsert("postgres") == 'INSERT INTO "s"."t" ("id", "v") VALUES (?, ?) ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"'
    assert upsert("postgres", ("id",)).endswith('ON CONFLICT ("id") DO NOTHING')
    assert upsert("mysql") == "INSERT INTO `s`.`t` (`id`, `v`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    assert upsert("mysql", ("id",)).endswith("UPDATE `id` = `id`")
    assert upsert("oracle") == 'MERGE INTO "s"."t" t USING (SELECT ? AS "id", ? AS "v" FROM dual) s ON (t."id" = s."id") WHEN MATCHED THEN UPDATE SET t."v" = s."v" WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (s."id", s."v")'
    assert upsert("sqlserver", ("id",)) == "MERGE INTO [s].[t] AS t USING (SELECT ? AS [id]) AS s ([id]) ON (t.[id] = s.[id]) WHEN NOT MATCHED THEN INSERT ([id]) VALUES (s.[id]);"
    assert Q.create_table("postgres", T) == 'CREATE TABLE "s"."order""s" ("id" bigint NOT NULL, "name" varchar, "price" numeric, PRIMARY KEY ("id"))'
    c = Column("n", CanonicalType(K.STRING))
    assert [Q.add_column(e, ref, c).split(".")[-1][4:] for e in ("postgres", "mysql", "oracle", "sqlserver")] == ['ADD COLUMN "n" varchar', "ADD COLUMN `n` varchar(255)", 'ADD ("n" varchar2(4000))', "ADD [n] nvarchar(max)"]
    assert Q.type_text("oracle", CanonicalType(K.LONG)) == "number(19,0)" and Q.type_text("mysql", CanonicalType(K.UUID)) == "char(36)" and Q.type_text("postgres", CanonicalType(K.DECIMAL, precision=10, scale=2)) == "numeric(10,2)"
    assert Q.create_schema("sqlserver", "it's").startswith("IF NOT EXISTS (SELECT * FROM sys.schemas WHERE name = 'it''s')")
    assert Q.ddl("oracle", [D.Action(D.CREATE_SCHEMA, schema="x")]) == []
    with pytest.raises(ConnectorError):
        Q.create_schema("oracle", "x")
    with pytest.raises(ConnectorError):
        Q.quote("mongodb", "x")


def test_types():
    for engine in Y.ENGINES:
        for kind in Kind:
            assert Y.from_canonical(engine, CanonicalType(kind))[0]
    assert Y.to_canonical("postgres", "VARCHAR", length=9) == CanonicalType(K.STRING, 9)
    with pytest.raises(ConnectorError):
        Y.to_canonical("postgres", "interval")
    assert Y.canonical_of(Y.spark_of(CanonicalType(K.DECIMAL, precision=9, scale=3))) == CanonicalType(K.DECIMAL, precision=9, scale=3)


def test_settings_and_logs():
    import logging

    for bad in ({"confidence": 1.1}, {"sample_size": 0}, {"key_ref": " "}):
        with pytest.raises(ConfigurationError):
            Settings(**bad)
    r = logging.LogRecord("x", 1, "", 1, "key %s!", ("hunter2",), None)
    assert SecretFilter("hunter2", "").filter(r) and r.getMessage() == "key ***!"
