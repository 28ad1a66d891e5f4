"""Queries over the driver's tables, and the SQL that each equals.

The tables hold no personal data, so columns of that kind are derived from keys, alike on both sides. The masking key
here is public and for tests only.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import masking as M
from .functions import rules as R
from .functions.corpora import EMAILS, NAMES
from .model import CanonicalType, Column, ColumnPlan, ForeignKey, Kind, MaskingRule, Plan, PlanValidationError, Schema, Source, Table, TablePlan, TableRef
from .operators import diff as D
from .operators import graph as G
from .operators import infer as I
from .operators import upsert as U
from .plans import control as C
from .plans import planner as P
from .plans import runner as X
from .plans.fingerprint import fingerprint
from .sources import scan as S
from .sources import types as Y

TEST_KEY = M.Key.of(b"a public key that masks test data only")

#: Natural keys of the driver's tables, and foreign keys between them.
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}
LINKS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
FOREIGN_KEYS = tuple(ForeignKey(TableRef(a), (b,), TableRef(c), (d,)) for a, b, c, d in LINKS)

#: Derived columns; each expression means the same in Spark and in DuckDB.
PII = {
    "ssn": "concat(lpad(cast({k}%1000 as string),3,'0'),'-',lpad(cast({k}%100 as string),2,'0'),'-',lpad(cast({k}%10000 as string),4,'0'))",
    "email": "concat('user',cast({k} as string),'@example.com')",
    "phone": "concat('(555) 010-',lpad(cast({k}%10000 as string),4,'0'))",
    "zip": "concat(lpad(cast(10000+{k}%90000 as string),5,'0'),case when {k}%2=0 then '-1234' else '' end)",
    "passport": "concat('A',lpad(cast({k} as string),8,'0'))",
    "pan": "case {k}%4 when 0 then '4111111111111111' when 1 then '5500000000000004' when 2 then '4111111111111112' else '4111 1111 1111 1111' end",
    "age": "cast({k}%110 as int)",
    "dob": "cast(date '1940-01-01' + cast({k}%20000 as int) as date)",
}


def _pii(name: str, k: str = "c_custkey", nulls: bool = False) -> str:
    e = PII[name].format(k=k)
    return f"case when {k}%10=0 then null else {e} end" if nulls else e


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- SQL pieces


def _hex(e: str, key: M.Key = TEST_KEY) -> str:
    return f"sha256(unhex('{key.outer}') || unhex(sha256(unhex('{key.inner}') || encode({e}))))"


def _url(e: str) -> str:
    return f"rtrim(translate(base64(unhex({_hex(e)})), '+/', '-_'), '=')"


def _synthetic(e: str, corpus) -> str:
    n = f"(('0x' || substr({_hex(e)}, 1, 16))::ubigint::hugeint)"
    signed = f"(CASE WHEN {n} >= 9223372036854775808 THEN {n} - 18446744073709551616 ELSE {n} END)"
    items = ", ".join(f"'{v}'" for v in corpus)
    return f"CASE WHEN {e} IS NULL THEN NULL ELSE [{items}][((({signed} % {len(corpus)}) + {len(corpus)}) % {len(corpus)} + 1)::int] END"


def _values(rows: list[tuple], columns: list[str]) -> str:
    lit = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({', '.join(columns)})"


_Q: dict = {}
_O: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql is not None:
            _O[name] = sql
        return f

    return add


# --- scans and projections


@_query("q_scan_project", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def _(spark, d):
    return S.drain(_t(spark, d, "orders")).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@_query("q_rename_project", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS region_id FROM nation")
def _(spark, d):
    plan = TablePlan(TableRef("nation"), TableRef("nation"), ("n_nationkey",), tuple(ColumnPlan(a, b) for a, b in (("n_nationkey", "id"), ("n_name", "label"), ("n_regionkey", "region_id"))))
    return M.mask(_t(spark, d, "nation"), plan, TEST_KEY)


@_query("q_keyset_first_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def _(spark, d):
    return S.page(_t(spark, d, "orders"), ["o_orderkey"], None, 500)


@_query("q_keyset_next_page", "SELECT * FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 500")
def _(spark, d):
    return S.page(_t(spark, d, "orders"), ["o_orderkey"], {"o_orderkey": 700}, 500)


@_query("q_keyset_composite_page", "SELECT * FROM conversations WHERE conv_id > 20 OR (conv_id = 20 AND turn > 0) ORDER BY conv_id, turn LIMIT 50")
def _(spark, d):
    return S.page(_t(spark, d, "conversations"), ["conv_id", "turn"], {"conv_id": 20, "turn": 0}, 50)


@_query("q_keyset_drain_counts", "SELECT count(*) AS n_rows, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer")
def _(spark, d):
    return S.drain(_t(spark, d, "customer")).agg(F.count("*").alias("n_rows"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


@_query("q_head_sample", "SELECT p_partkey, p_name, p_brand, p_size FROM part ORDER BY p_partkey LIMIT 20")
def _(spark, d):
    return S.head_sample(_t(spark, d, "part"), list(KEYS["part"])).select("p_partkey", "p_name", "p_brand", "p_size")


# --- masking


def _masked(table: str, key: str, derived: str, rule: MaskingRule, out: str, k: str | None = None, nulls=False):
    """A query of the key and one masked derived column."""

    def run(spark, d):
        rows = _t(spark, d, table).selectExpr(key, f"{_pii(derived, k or key, nulls) if derived in PII else derived} as v")
        plan = TablePlan(TableRef(table), TableRef(table), (key,), (ColumnPlan(key, key), ColumnPlan("v", out, True, rule)))
        return M.mask(rows, plan, TEST_KEY)

    return run


def _masked_query(name: str, table: str, key: str, derived: str, rule: MaskingRule, out: str, sql, k=None, nulls=False):
    """sql: the masked value from v."""
    e = _pii(derived, k or key, nulls) if derived in PII else derived
    _Q[name] = _masked(table, key, derived, rule, out, k, nulls)
    _O[name] = f"SELECT {key}, {sql('v')} AS {out} FROM (SELECT {key}, {e} AS v FROM {table})"


_partial = lambda n: lambda v: f"CASE WHEN {v} IS NULL THEN NULL ELSE concat(repeat('*', greatest(length({v}) - {n}, 0)::bigint), right({v}, {n})) END"
_masked_query("q_hmac_hex", "customer", "c_custkey", "email", MaskingRule("HASH_HMAC", encoding="HEX"), "masked", _hex)
_masked_query("q_hmac_base64url", "customer", "c_custkey", "ssn", MaskingRule("HASH_HMAC"), "masked", _url)
_masked_query("q_hmac_null_and_unicode", "documents", "doc_id", "case when doc_id%10=0 then null else text end", MaskingRule("HASH_HMAC", encoding="HEX"), "masked", _hex)
_masked_query("q_hmac_integer_key", "orders", "o_orderkey", "o_custkey", MaskingRule("HASH_HMAC"), "masked", lambda v: _url(f"cast({v} AS varchar)"))
_masked_query("q_redact_full", "supplier", "s_suppkey", "case when s_suppkey%10=0 then null else s_name end", MaskingRule("REDACT_FULL"), "masked", lambda v: f"CASE WHEN {v} IS NOT NULL THEN 'REDACTED' END")
_masked_query("q_redact_partial_default", "customer", "c_custkey", "pan", MaskingRule("REDACT_PARTIAL"), "masked", _partial(4), nulls=True)
_masked_query("q_redact_partial_k", "customer", "c_custkey", "c_name", MaskingRule("REDACT_PARTIAL", keep_last=2), "masked", _partial(2))
_masked_query("q_year_bucket", "orders", "o_orderkey", "o_orderdate", MaskingRule("GENERALIZE_BUCKET", granularity="YEAR"), "order_year", lambda v: f"year({v})::int")
_masked_query("q_year_bucket_date", "customer", "c_custkey", "dob", MaskingRule("GENERALIZE_BUCKET", granularity="year"), "birth_year", lambda v: f"year({v})::int", nulls=True)
_masked_query("q_year_bucket_string", "orders", "o_orderkey", "cast(o_orderdate as string)", MaskingRule("GENERALIZE_BUCKET", granularity="YEAR"), "order_year", lambda v: f"substr({v}, 1, 4)::int")
_masked_query("q_zip3", "customer", "c_custkey", "zip", MaskingRule("GENERALIZE_BUCKET", granularity="ZIP3"), "zip3", lambda v: f"substr({v}, 1, 3)", nulls=True)
_masked_query("q_age_5year_band", "part", "p_partkey", "p_size", MaskingRule("GENERALIZE_BUCKET", granularity="AGE_5YEAR_BAND"), "band", lambda v: f"concat({v} // 5 * 5, '-', {v} // 5 * 5 + 4)")
_masked_query("q_age_90_plus", "customer", "c_custkey", "age", MaskingRule("GENERALIZE_BUCKET", granularity="AGE_90_PLUS"), "age", lambda v: f"CASE WHEN {v} >= 90 THEN '90+' ELSE cast({v} AS varchar) END", nulls=True)
_masked_query("q_synthetic_name", "customer", "c_custkey", "c_name", MaskingRule("SYNTHETIC_SUBSTITUTION"), "masked", lambda v: _synthetic(v, NAMES))
_masked_query("q_synthetic_email", "customer", "c_custkey", "email", MaskingRule("SYNTHETIC_SUBSTITUTION", corpus="email"), "masked", lambda v: _synthetic(v, EMAILS), nulls=True)

CUSTOMER_PLAN = TablePlan(
    TableRef("customer"), TableRef("customer"), ("c_custkey",),
    (
        ColumnPlan("c_custkey", "customer_key", True, MaskingRule("HASH_HMAC"), decision=Source.OVERRIDE_KEY),
        ColumnPlan("c_name", "name", True, MaskingRule("SYNTHETIC_SUBSTITUTION")),
        ColumnPlan("c_nationkey", "nation_key"),
        ColumnPlan("c_mktsegment", "segment", True, MaskingRule("REDACT_PARTIAL", keep_last=3)),
        ColumnPlan("c_acctbal", "balance"),
    ),
)


@_query("q_mask_row_customer", f"""SELECT {_url("cast(c_custkey AS varchar)")} AS customer_key, {_synthetic("c_name", NAMES)} AS name, c_nationkey AS nation_key, {_partial(3)("c_mktsegment")} AS segment, c_acctbal AS balance FROM customer""")
def _(spark, d):
    return M.mask(_t(spark, d, "customer"), CUSTOMER_PLAN, TEST_KEY)


# --- rules

_LUHN = "length({s}) BETWEEN 13 AND 19 AND regexp_full_match({s}, '[0-9]+') AND list_sum(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN (length({s}) - i) % 2 = 1 THEN (substr({s}, i, 1)::int * 2) // 10 + (substr({s}, i, 1)::int * 2) % 10 ELSE substr({s}, i, 1)::int END)) % 10 = 0"


def _rule_sql(rule: str, v: str) -> str:
    if rule == R.CARD:
        s = f"regexp_replace({v}, '[\\s-]', '', 'g')"
        return f"(CASE WHEN regexp_full_match({s}, '[0-9]{{13,19}}') THEN {_LUHN.format(s=s)} ELSE false END)"
    return f"regexp_full_match({v}, '{R.PATTERNS[rule]}')"


def _rule_query(name: str, rule: str, derived: str):
    def run(spark, d):
        rows = _t(spark, d, "customer").selectExpr("c_custkey", f"{_pii(derived)} as v")
        return rows.select("c_custkey", "v", R.matches(R.trimmed(F.col("v")), rule).alias("hit"))

    _Q[name] = run
    _O[name] = f"SELECT c_custkey, v, {_rule_sql(rule, 'v')} AS hit FROM (SELECT c_custkey, {_pii(derived)} AS v FROM customer)"


for _n, _r, _c in (("ssn", "US_SSN", "ssn"), ("email", "EMAIL", "email"), ("phone", "PHONE_US", "phone"), ("zip", "US_ZIP", "zip"), ("passport", "PASSPORT_GENERIC", "passport"), ("credit_card", R.CARD, "pan")):
    _rule_query(f"q_rule_{_n}", _r, _c)


def _profile_sql(table: str, columns: list[str], rows: str = "") -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", '{r}' AS rule, count(*) AS n, (count(*) FILTER (WHERE {_rule_sql(r, 'v')}))::double / count(*) AS rate FROM (SELECT trim(cast({c} AS varchar)) AS v FROM {rows or table}) WHERE v <> ''"
        for c in columns
        for r in R.RULES
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rate > 0"


_RATED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_PEOPLE = f"(SELECT {', '.join(f'{_pii(n, nulls=True)} AS {n}' for n in ('ssn', 'email', 'phone', 'zip', 'passport', 'pan'))} FROM customer)"


@_query("q_match_rates", _profile_sql("orders", _RATED))
def _(spark, d):
    return R.profile(_t(spark, d, "orders"), _RATED)


@_query("q_match_rates_people", _profile_sql("", ["ssn", "email", "phone", "zip", "passport", "pan"], _PEOPLE))
def _(spark, d):
    return R.profile(_t(spark, d, "customer").selectExpr(*[f"{_pii(n, nulls=True)} as {n}" for n in ("ssn", "email", "phone", "zip", "passport", "pan")]))


@_query("q_max_rate_verdict", f"SELECT \"column\", max(rate) AS max_rate, max(rate) >= 0.5 AS sensitive FROM ({_profile_sql('orders', _RATED)}) GROUP BY 1")
def _(spark, d):
    return R.verdicts(R.profile(_t(spark, d, "orders"), _RATED))


@_query("q_head_vs_full_rate", f"SELECT 'full' AS sample, \"column\", rule, rate FROM ({_profile_sql('orders', ['o_orderkey', 'o_custkey'])}) UNION ALL SELECT 'head', \"column\", rule, rate FROM ({_profile_sql('', ['o_orderkey', 'o_custkey'], '(SELECT * FROM orders ORDER BY o_orderkey LIMIT 20)')})")
def _(spark, d):
    orders, columns = _t(spark, d, "orders"), ["o_orderkey", "o_custkey"]
    rows = R.profile(orders, columns).withColumn("sample", F.lit("full")).unionByName(R.profile(S.head_sample(orders, ["o_orderkey"]), columns).withColumn("sample", F.lit("head")))
    return rows.select("sample", "column", "rule", "rate")


# --- plans

_CASES = [(ai, conf, rate, forced, key, over) for ai, conf in ((None, 1.0), (False, 1.0), (True, 0.9), (True, 0.5)) for rate in (0.0, 0.5) for forced in (False, True) for key in (False, True) for over in (False, True)]


@_query("q_verdict_table", f"""
WITH c AS (SELECT *, coalesce(ai, false) OR rate >= 0.5 OR forced OR override AS s FROM {_values(_CASES, ['ai', 'confidence', 'rate', 'forced', 'is_key', 'override'])})
SELECT ai, confidence::double AS confidence, rate::double AS rate, forced, is_key, override, s AS sensitive,
  CASE WHEN NOT s THEN NULL WHEN is_key THEN 'HASH_HMAC' WHEN override THEN 'REDACT_PARTIAL' WHEN ai AND confidence >= 0.85 THEN 'SYNTHETIC_SUBSTITUTION' ELSE 'REDACT_FULL' END AS technique,
  CASE WHEN NOT s THEN CASE WHEN ai IS NULL THEN 'rule' ELSE 'ai' END WHEN is_key THEN 'override-key-column' WHEN override THEN 'override' WHEN ai AND confidence >= 0.85 THEN CASE WHEN rate >= 0.5 THEN 'ai+rule' ELSE 'ai' END WHEN ai THEN 'low-confidence-fallback' ELSE 'rule' END AS source
FROM c""")
def _(spark, d):
    rows = []
    for ai, conf, rate, forced, key, over in _CASES:
        hint = None if ai is None else P.Hint(ai, conf, "SYNTHETIC_SUBSTITUTION")
        s, rule, _, where = P.decide(hint, rate, forced, key, MaskingRule("REDACT_PARTIAL") if over else None, 0.85)
        rows.append((ai, conf, rate, forced, key, over, s, rule.technique if rule else None, where.value))
    return spark.createDataFrame(rows, "ai boolean, confidence double, rate double, forced boolean, is_key boolean, override boolean, sensitive boolean, technique string, source string")


_EDGES = [(f"{a}.{b}", f"{c}.{e}") for a, b, c, e in LINKS]


@_query("q_fk_closure", f"""
WITH RECURSIVE e AS (SELECT a, b FROM {_values(_EDGES, ['a', 'b'])} UNION ALL SELECT b, a FROM {_values(_EDGES, ['a', 'b'])}),
r(col) AS (SELECT 'customer.c_custkey' UNION SELECT 'supplier.s_nationkey' UNION SELECT e.b FROM r JOIN e ON e.a = r.col)
SELECT col AS column_name FROM r""")
def _(spark, d):
    found = P.closure({(TableRef("customer"), "c_custkey"), (TableRef("supplier"), "s_nationkey")}, FOREIGN_KEYS)
    return spark.createDataFrame([(f"{t.name}.{c}",) for t, c in found], "column_name string")


def _hashed(spark, d, table: str, columns: dict[str, str]) -> DataFrame:
    plan = TablePlan(TableRef(table), TableRef(table), tuple(columns), tuple(ColumnPlan(c, a, True, MaskingRule("HASH_HMAC")) for c, a in columns.items()))
    return M.mask(_t(spark, d, table), plan, TEST_KEY)


@_query("q_masked_fk_orders_customer", f"SELECT {_url('cast(c_custkey AS varchar)')} AS k, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    return _hashed(spark, d, "orders", {"o_custkey": "k"}).join(_hashed(spark, d, "customer", {"c_custkey": "k"}), "k").groupBy("k").agg(F.count("*").alias("n_orders"))


@_query("q_masked_fk_lineitem_part", f"SELECT {_url('cast(p_partkey AS varchar)')} AS k, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey")
def _(spark, d):
    return _hashed(spark, d, "lineitem", {"l_partkey": "k"}).join(_hashed(spark, d, "part", {"p_partkey": "k"}), "k").groupBy("k").agg(F.count("*").alias("n_lines"))


@_query("q_masked_fk_orphans", "SELECT v.* FROM " + _values([(f"{a}.{b}", 0) for a, b, _, _ in LINKS], ["foreign_key", "orphans"]))
def _(spark, d):
    out = None
    for child, a, parent, b in LINKS:
        left = _hashed(spark, d, child, {a: "k"}).join(_hashed(spark, d, parent, {b: "k"}), "k", "left_anti").agg(F.count("*").cast("int").alias("orphans")).select(F.lit(f"{child}.{a}").alias("foreign_key"), "orphans")
        out = left if out is None else out.unionByName(left)
    return out


@_query("q_masked_fk_composite", f"SELECT {_url('cast(conv_id AS varchar)')} AS a, {_url('cast(turn AS varchar)')} AS b FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    turns = _t(spark, d, "conversations")
    columns = {"conv_id": "a", "turn": "b"}
    plan = TablePlan(TableRef("conversations"), TableRef("conversations"), ("conv_id", "turn"), tuple(ColumnPlan(c, x, True, MaskingRule("HASH_HMAC")) for c, x in columns.items()))
    return M.mask(turns.filter("role = 'assistant'"), plan, TEST_KEY).join(M.mask(turns, plan, TEST_KEY), ["a", "b"], "left_semi")


# --- upserts

_OLD = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0"
_NEW = "SELECT c_custkey, concat('new ', c_name) AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0"


def _old_new(spark, d):
    c = _t(spark, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return old, c.filter("c_custkey % 2 = 0").selectExpr("c_custkey", "concat('new ', c_name) as c_name", "c_acctbal + 1 as c_acctbal")


_MERGED = f"SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_name ELSE n.c_name END AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal, o.c_mktsegment AS c_mktsegment FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey"


@_query("q_upsert_mixed", _MERGED)
def _(spark, d):
    return U.merge(*_old_new(spark, d), ["c_custkey"]).drop("__change")


@_query("q_upsert_counts", "SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS inserted, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS updated FROM customer WHERE c_custkey % 2 = 0")
def _(spark, d):
    merged = U.merge(*_old_new(spark, d), ["c_custkey"])
    return merged.agg(F.count_if(F.col("__change") == "inserted").alias("inserted"), F.count_if(F.col("__change") == "updated").alias("updated"))


@_query("q_upsert_idempotent", _MERGED)
def _(spark, d):
    old, new = _old_new(spark, d)
    once = U.merge(old, new, ["c_custkey"]).drop("__change")
    return U.merge(once, new, ["c_custkey"]).drop("__change")


@_query("q_upsert_do_nothing", "SELECT r_regionkey FROM region")
def _(spark, d):
    r = _t(spark, d, "region").select("r_regionkey")
    return U.merge(r, r.filter("r_regionkey < 3"), ["r_regionkey"]).drop("__change")


@_query("q_upsert_replace_document", _MERGED.replace("o.c_mktsegment AS c_mktsegment", "CASE WHEN n.c_custkey IS NULL THEN o.c_mktsegment END AS c_mktsegment"))
def _(spark, d):
    return U.merge(*_old_new(spark, d), ["c_custkey"], document=True).drop("__change")


@_query("q_upsert_last_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    return U.merge(e.limit(0), e, ["user_id"], order=["event_id"]).drop("__change")


_NULLS = "SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS k, c_name FROM customer"


@_query("q_upsert_null_key", f"WITH a AS ({_NULLS}) SELECT k, c_name FROM a WHERE k IS NOT NULL UNION ALL SELECT k, c_name FROM a WHERE k IS NULL UNION ALL SELECT k, c_name FROM a WHERE k IS NULL")
def _(spark, d):
    rows = _t(spark, d, "customer").selectExpr("case when c_custkey % 5 = 0 then null else c_custkey end as k", "c_name")
    return U.merge(rows, rows, ["k"]).drop("__change")


# --- schemas


@_query("q_schema_infer", "WITH v AS (SELECT unnest(json_keys(props)) AS field, props FROM events), t AS (SELECT field, CASE json_type(props, '$.' || field) WHEN 'UBIGINT' THEN 'int64' WHEN 'BIGINT' THEN 'int64' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'bool' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'string' END AS type FROM v), c AS (SELECT field, type, count(*) AS votes FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY type = 'null', votes DESC, type) AS r, sum(CASE WHEN type <> 'null' THEN votes ELSE 0 END) OVER (PARTITION BY field) AS p FROM c) SELECT field, CASE type WHEN 'null' THEN 'string' ELSE type END AS type, votes, p < (SELECT count(*) FROM events) AS nullable FROM r WHERE r = 1")
def _(spark, d):
    return I.infer(_t(spark, d, "events"), "props", sample=None)


#: Canonical kinds of native types, by engine.
_MAPPED = {
    "postgres": "varchar STRING, bpchar STRING, text TEXT, int2 INTEGER, int4 INTEGER, int8 LONG, numeric DECIMAL, bool BOOLEAN, date DATE, timestamp TIMESTAMP, timestamptz TIMESTAMP, bytea BINARY, uuid UUID",
    "mysql": "varchar STRING, char STRING, text TEXT, longtext TEXT, tinyint BOOLEAN, smallint INTEGER, int INTEGER, bigint LONG, decimal DECIMAL, numeric DECIMAL, date DATE, datetime TIMESTAMP, timestamp TIMESTAMP, blob BINARY, varbinary BINARY, binary BINARY",
    "oracle": "varchar2 STRING, nvarchar2 STRING, char STRING, clob TEXT, nclob TEXT, date DATE, timestamp TIMESTAMP, blob BINARY, raw BINARY",
    "sqlserver": "nvarchar STRING, varchar STRING, nchar STRING, char STRING, text TEXT, ntext TEXT, int INTEGER, smallint INTEGER, bigint LONG, decimal DECIMAL, numeric DECIMAL, bit BOOLEAN, date DATE, datetime2 TIMESTAMP, datetime TIMESTAMP, varbinary BINARY, binary BINARY, uniqueidentifier UUID",
    "mongodb": "string STRING, objectid STRING, int32 INTEGER, int64 LONG, double DECIMAL, decimal128 DECIMAL, bool BOOLEAN, date TIMESTAMP, bindata BINARY, array TEXT, object TEXT",
}
_MAPPED_ROWS = [(e, *x.split()) for e, pairs in _MAPPED.items() for x in pairs.split(", ")]


@_query("q_type_map", "SELECT * FROM " + _values(_MAPPED_ROWS, ["engine", "native", "canonical"]))
def _(spark, d):
    rows = [(e, n, Y.to_canonical(e, n.upper()).kind.value) for e, n, _ in _MAPPED_ROWS]
    return spark.createDataFrame(rows, "engine string, native string, canonical string")


_NUMBERS = [(p, s) for p in (None, 1, 2, 9, 10, 19, 20, 38) for s in (None, 0, 2)]


@_query("q_oracle_number_map", f"""SELECT p::int AS p, s::int AS s, CASE WHEN s <> 0 THEN 'DECIMAL' WHEN p = 1 THEN 'BOOLEAN' WHEN p <= 9 THEN 'INTEGER' WHEN p <= 19 THEN 'LONG' ELSE 'DECIMAL' END AS kind,
  CASE WHEN s <> 0 OR p IS NULL OR p > 19 THEN coalesce(p, 38) END::int AS "precision", CASE WHEN s <> 0 OR p IS NULL OR p > 19 THEN coalesce(s, 0) END::int AS "scale" FROM {_values(_NUMBERS, ['p', 's'])}""")
def _(spark, d):
    rows = [(p, s, t.kind.value, t.precision, t.scale) for p, s in _NUMBERS for t in [Y.to_canonical("oracle", "NUMBER", precision=p, scale=s)]]
    return spark.createDataFrame(rows, "p int, s int, kind string, precision int, scale int")


_K = {"INTEGER": Kind.INTEGER, "LONG": Kind.LONG, "STRING": Kind.STRING, "BOOLEAN": Kind.BOOLEAN}
_DESIRED = [("customers", "id", "INTEGER"), ("customers", "tier", "STRING"), ("customers", "ssn", "STRING"), ("fresh", "id", "LONG"), ("orders", "id", "LONG"), ("orders", "paid", "BOOLEAN")]
_EXISTING = [("customers", "ID", "LONG"), ("customers", "ssn", "BOOLEAN"), ("orders", "id", "INTEGER"), ("orders", "paid", "BOOLEAN"), ("other", "x", "STRING")]


def _model(rows) -> Schema:
    names = list(dict.fromkeys(t for t, _, _ in rows))
    return Schema(tuple(Table(TableRef(n), tuple(Column(c, CanonicalType(_K[k])) for t, c, k in rows if t == n)) for n in names))


@_query("q_schema_diff", f"""
WITH d AS (SELECT * FROM {_values(_DESIRED, ['t', 'c', 'k'])}), e AS (SELECT * FROM {_values(_EXISTING, ['t', 'c', 'k'])})
SELECT DISTINCT 'CREATE_TABLE' AS what, t AS table_name, NULL AS column_name FROM d WHERE t NOT IN (SELECT t FROM e)
UNION ALL SELECT CASE WHEN e.c IS NULL THEN 'ADD_COLUMN' ELSE 'CONFLICT' END, d.t, d.c FROM d LEFT JOIN e ON d.t = e.t AND lower(d.c) = lower(e.c)
WHERE d.t IN (SELECT t FROM e) AND (e.c IS NULL OR NOT (d.k = e.k OR (d.k = 'INTEGER' AND e.k = 'LONG')))""")
def _(spark, d):
    found = D.diff(_model(_DESIRED), _model(_EXISTING))
    rows = [(a.type, a.table.name, a.column.name if a.column else None) for a in found.actions] + [("CONFLICT", c.table.name, c.column) for c in found.conflicts]
    return spark.createDataFrame(rows, "what string, table_name string, column_name string")


_PLANNED = [("a", "id", True), ("a", "x", False), ("b", "id", True), ("b", "y", False), ("c", "id", True), ("c", "z", False), ("e", "id", True)]
_BAD = [("a", "x"), ("b", "id")]
_NEEDS = [("c", "b"), ("d", "c")]


@_query("q_conflict_prune", f"""
WITH RECURSIVE p AS (SELECT * FROM {_values(_PLANNED, ['t', 'c', 'k'])}), b AS (SELECT * FROM {_values(_BAD, ['t', 'c'])}), n AS (SELECT * FROM {_values(_NEEDS, ['child', 'parent'])}),
gone(t) AS (SELECT b.t FROM b JOIN p ON b.t = p.t AND b.c = p.c AND p.k UNION SELECT n.child FROM n JOIN gone ON n.parent = gone.t)
SELECT t AS table_name, c AS column_name FROM p WHERE t NOT IN (SELECT t FROM gone) AND NOT EXISTS (SELECT 1 FROM b WHERE b.t = p.t AND b.c = p.c)""")
def _(spark, d):
    names = list(dict.fromkeys(t for t, _, _ in _PLANNED))
    tables = tuple(TablePlan(TableRef(n), TableRef(n), tuple(c for t, c, k in _PLANNED if t == n and k), tuple(ColumnPlan(c, c) for t, c, _ in _PLANNED if t == n)) for n in names)
    graph = G.build_graph(Schema(()), tuple(ForeignKey(TableRef(a), ("x",), TableRef(b), ("id",)) for a, b in [*_NEEDS, ("a", "a"), ("e", "e")]))
    plan, _ = D.prune(Plan("f", "now", tables), D.Diff((), tuple(D.Conflict(TableRef(t), c, "STRING", "LONG") for t, c in _BAD)), graph)
    return spark.createDataFrame([(t.source.name, c.source) for t in plan.tables for c in t.columns], "table_name string, column_name string")


_SCHEMA = Schema(_model(_DESIRED).tables, (ForeignKey(TableRef("orders"), ("id",), TableRef("customers"), ("id",)),))


#: What is hashed for _SCHEMA: the stored format.
_FINGERPRINTED = """TABLE:customers
  COL:id:INTEGER:true:false
  COL:ssn:STRING:true:false
  COL:tier:STRING:true:false
  PK:
TABLE:fresh
  COL:id:LONG:true:false
  PK:
TABLE:orders
  COL:id:LONG:true:false
  COL:paid:BOOLEAN:true:false
  PK:
FK:orders[id]->customers[id]
"""


@_query("q_fingerprint", "SELECT 'sha256:' || sha256(v.text) AS fingerprint FROM " + _values([(_FINGERPRINTED,)], ["text"]))
def _(spark, d):
    mixed = Schema(tuple(Table(t.ref, t.columns[::-1], t.key) for t in _SCHEMA.tables[::-1]), _SCHEMA.foreign_keys)
    return spark.createDataFrame([(fingerprint(mixed),)], "fingerprint string")


# --- graphs

_PAIRS = [(a, c) for a, _, c, _ in LINKS]
_DEPTHS = f"""
WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM {_values(_PAIRS, ['a', 'b'])}), n AS (SELECT a AS t FROM e UNION SELECT b FROM e),
r(t, depth) AS (SELECT t, 0 FROM n UNION SELECT e.a, r.depth + 1 FROM r JOIN e ON e.b = r.t),
l AS (SELECT t, max(depth)::int AS layer FROM r GROUP BY t)"""


def _fixture_graph():
    return G.build_graph(Schema(()), FOREIGN_KEYS)


@_query("q_load_layers", f"{_DEPTHS} SELECT t AS table_name, layer FROM l")
def _(spark, d):
    return spark.createDataFrame([(t.name, i) for i, layer in enumerate(_fixture_graph().load_layers()) for t in layer], "table_name string, layer int")


@_query("q_topo_order", f"{_DEPTHS} SELECT t AS table_name, (row_number() OVER (ORDER BY layer, t))::int AS load_order FROM l")
def _(spark, d):
    return spark.createDataFrame([(t.name, i) for i, t in enumerate(_fixture_graph().load_order(), 1)], "table_name string, load_order int")


@_query("q_transitive_dependents", f"WITH RECURSIVE e AS (SELECT a, b FROM {_values(_PAIRS, ['a', 'b'])}), r(root, t) AS (SELECT b, a FROM e UNION SELECT r.root, e.a FROM r JOIN e ON e.b = r.t) SELECT root, t AS dependent FROM r")
def _(spark, d):
    g = _fixture_graph()
    return spark.createDataFrame([(t.name, x.name) for t in g.parents for x in g.dependents(t)], "root string, dependent string")


_RINGS = [("a", "b"), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "g"), ("h", "d")]


@_query("q_detect_cycles", f"WITH RECURSIVE e AS (SELECT a, b FROM {_values(_RINGS, ['a', 'b'])} WHERE a <> b), r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), m AS (SELECT r.x, r.y FROM r JOIN r q ON r.x = q.y AND r.y = q.x) SELECT x AS table_name, min(y) AS cycle FROM m GROUP BY x")
def _(spark, d):
    g = G.build_graph(Schema(()), tuple(ForeignKey(TableRef(a), ("x",), TableRef(b), ("y",)) for a, b in _RINGS))
    return spark.createDataFrame([(t.name, min(x.name for x in c)) for c in g.cycles() for t in c], "table_name string, cycle string")


# --- runs


class _Memory:
    """A destination that fails for some tables and keeps nothing."""

    deferred_constraints = False

    def __init__(self, bad):
        self.bad = bad

    def upsert(self, df, ref, key, order=None):
        if ref.table in self.bad:
            raise RuntimeError("planted")
        return U.Upserted(df.count(), 0)


@_query("q_skip_propagation", f"WITH RECURSIVE e AS (SELECT a, b FROM {_values(_PAIRS, ['a', 'b'])}), n AS (SELECT a AS t FROM e UNION SELECT b FROM e), r(t) AS (SELECT a FROM e WHERE b = 'nation' UNION SELECT e.a FROM r JOIN e ON e.b = r.t) SELECT t AS table_name, CASE WHEN t = 'nation' THEN 'FAILED' WHEN t IN (SELECT t FROM r) THEN 'SKIPPED' ELSE 'COMPLETED' END AS outcome FROM n")
def _(spark, d):
    from .plans.config import Settings
    from .sources.connectors import source

    names = [t.name for t in _fixture_graph().load_order()]
    files = source("parquet")(d, {n: KEYS[n] for n in names}, FOREIGN_KEYS)
    plan = P.generate(files.schema(spark), {}, Settings(), now="now")
    done = X.Loader(spark, files, _Memory({"nation"}), TEST_KEY, _fixture_graph(), Settings()).load_all(plan)
    return spark.createDataFrame([(t.name, o.status) for t, o in done.items()], "table_name string, outcome string")


_AUDITED = [("t", "ssn", "GDPR,CCPA"), ("t", "email", "GDPR-EXTRA"), ("t", "name", ""), ("u", "pan", "PCI-DSS"), ("u", "zip", "GDPR")]


@_query("q_audit_by_basis", f"SELECT t AS table_name, c AS column_name FROM {_values(_AUDITED, ['t', 'c', 'b'])} WHERE list_contains(string_split(b, ','), 'GDPR')")
def _(spark, d):
    rows = [("run", t, c, "REDACT_FULL", 1.0, "ai", b) for t, c, b in _AUDITED]
    return C.masked_for(spark.createDataFrame(rows, C.AUDIT["audit_column_masking"]), "GDPR").select("table_name", "column_name")


_RUNS = [("all", "COMPLETED", "COMPLETED", False), ("failed", "COMPLETED", "FAILED", False), ("skipped", "SKIPPED", "COMPLETED", False), ("pruned", "COMPLETED", "COMPLETED", True)]


@_query("q_run_outcome", f"SELECT name, CASE WHEN a <> 'COMPLETED' OR b <> 'COMPLETED' OR pruned THEN 'PARTIAL_FAILURE' ELSE 'SUCCESS' END AS outcome, CASE WHEN a <> 'COMPLETED' OR b <> 'COMPLETED' OR pruned THEN 1 ELSE 0 END AS exit_code FROM {_values(_RUNS, ['name', 'a', 'b', 'pruned'])}")
def _(spark, d):
    rows = []
    for name, a, b, pruned in _RUNS:
        o = X.outcome_of({TableRef("a"): X.Outcome(a), TableRef("b"): X.Outcome(b)}, pruned)
        rows.append((name, o, X.EXIT[o]))
    return spark.createDataFrame(rows, "name string, outcome string, exit_code int")


@_query("q_key_validation", "SELECT * FROM " + _values([("HASH_HMAC", True), ("REDACT_FULL", False), ("REDACT_PARTIAL", False), ("GENERALIZE_BUCKET", False), ("SYNTHETIC_SUBSTITUTION", False)], ["technique", "allowed"]))
def _(spark, d):
    rows = []
    for name in M.TECHNIQUES:
        rule = MaskingRule(name, granularity="YEAR" if name == "GENERALIZE_BUCKET" else None)
        plan = TablePlan(TableRef("t"), TableRef("t"), ("id",), (ColumnPlan("id", "key", True, rule),))
        try:
            M.validate_keys(plan, ["KEY"])
            rows.append((name, True))
        except PlanValidationError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "technique string, allowed boolean")


def _copied(spark, d) -> DataFrame:
    """A stream over the table, upserted by micro-batch into the shared folder."""
    from .sources.connectors import destination
    from .streaming.copy import copy, masked_stream

    shared = spark.conf.get("spark.checkpoint.dir", "") or os.path.join(os.environ.get("TMPDIR", "/tmp"), "veilshift-stream")
    root = f"{shared.rstrip('/')}/stream-{hashlib.sha256(os.urandom(16)).hexdigest()[:16]}"
    schema = _t(spark, d, "customer").schema
    rows = masked_stream(spark, d, schema, CUSTOMER_PLAN, TEST_KEY, only="customer.parquet")
    target = destination("parquet")(root, {"customer": ("customer_key",)})
    q = copy(rows, target, CUSTOMER_PLAN, f"{root}/checkpoint")
    q.awaitTermination()
    return target.read(spark, TableRef("customer"))


_query("q_stream_copy", _O["q_mask_row_customer"])(_copied)


def queries() -> dict:
    from . import checks  # noqa: F401  registers more

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import checks  # noqa: F401

    return dict(_O)
