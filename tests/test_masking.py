import base64
import datetime
import hashlib
import hmac
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veilshift.functions import masking as M
from veilshift.functions.corpora import EMAILS, NAMES
from veilshift.model import ColumnPlan, ConfigurationError, MaskingRule, PlanValidationError, TablePlan, TableRef

T = TableRef("t")


def masked(spark, values, kind, rule, key=b"k"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    plan = TablePlan(T, T, ("v",), (ColumnPlan("v", "m", True, rule),))
    return [r.m for r in M.mask(df, plan, M.Key.of(key)).collect()]


TEXTS = [None, "", " \t", "a\n", "é日本😀", "x" * 300, "plain"]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 65, bytes(range(200))])
def test_hmac(spark, key):
    want = [None if v is None else hmac.new(key, v.encode(), hashlib.sha256).digest() for v in TEXTS]
    assert masked(spark, TEXTS, "string", MaskingRule("HASH_HMAC", encoding="hex"), key) == [w and w.hex() for w in want]
    assert masked(spark, TEXTS, "string", MaskingRule("HASH_HMAC"), key) == [w and base64.urlsafe_b64encode(w).decode().rstrip("=") for w in want]
    n = [None if w is None else struct.unpack(">q", w[:8])[0] for w in want]
    assert masked(spark, TEXTS, "string", MaskingRule("SYNTHETIC_SUBSTITUTION"), key) == [None if x is None else NAMES[x % 60] for x in n]
    assert masked(spark, TEXTS, "string", MaskingRule("SYNTHETIC_SUBSTITUTION", corpus="email"), key) == [None if x is None else EMAILS[x % 60] for x in n]


def test_canonical_values(spark):
    h = MaskingRule("HASH_HMAC", encoding="HEX")
    of = lambda s: hmac.new(b"k", s.encode(), hashlib.sha256).hexdigest()
    assert masked(spark, [42], "int", h) == masked(spark, [42], "bigint", h) == masked(spark, ["42"], "string", h) == [of("42")]
    assert masked(spark, [Decimal("42.00")], "decimal(10,2)", h) == [of("42.00")]
    assert masked(spark, [True], "boolean", h) == [of("true")]
    assert masked(spark, [datetime.date(1990, 7, 14)], "date", h) == [of("1990-07-14")]
    assert masked(spark, [b"\xff\x00"], "binary", h) == [of("ff00")]
    assert masked(spark, [[1, 2]], "array<int>", h) == [of("[1,2]")]


def test_redaction(spark):
    assert masked(spark, ["x", "", None], "string", MaskingRule("REDACT_FULL")) == ["REDACTED", "REDACTED", None]
    assert masked(spark, ["4111111111111111", "12", "", None, "日本語文字😀"], "string", MaskingRule("REDACT_PARTIAL")) == ["*" * 12 + "1111", "12", "", None, "**語文字😀"]
    assert masked(spark, ["abc"], "string", MaskingRule("REDACT_PARTIAL", keep_last=0)) == ["***"]


def bucket(g):
    return MaskingRule("GENERALIZE_BUCKET", granularity=g)


def test_generalization(spark):
    assert masked(spark, ["1990-07-14", "1969-12-31T01:02:03Z", None], "string", bucket("year")) == [1990, 1969, None]
    assert masked(spark, [datetime.date(1990, 7, 14)], "date", bucket("YEAR")) == [1990]
    assert masked(spark, ["94107-1234", "94", None], "string", bucket("ZIP3")) == ["941", "94", None]
    assert masked(spark, [42, 45, 0, None, -3, -7], "int", bucket("AGE_5YEAR_BAND")) == ["40-44", "45-49", "0-4", None, "0-4", "-5--1"]
    assert masked(spark, [" 90 ", "101", "89", None], "string", bucket("AGE_90_PLUS")) == ["90+", "90+", "89", None]
    assert masked(spark, [42.9], "double", bucket("AGE_5YEAR_BAND")) == ["40-44"]


@pytest.mark.parametrize("value, g", [("no date", "YEAR"), ("secret-age", "AGE_90_PLUS"), ("4.5", "AGE_5YEAR_BAND")])
def test_errors_tell_no_value(spark, value, g):
    with pytest.raises(Exception) as e:
        masked(spark, [value], "string", bucket(g))
    assert "column v" in str(e.value) and value not in str(e.value).split("== SQL ==")[0].splitlines()[0]


def test_rules_are_checked_when_compiled(spark):
    for rule in (MaskingRule("NOPE"), MaskingRule("HASH_HMAC", encoding="base32"), bucket(None), bucket("DECADE"), MaskingRule("SYNTHETIC_SUBSTITUTION", corpus="Name")):
        with pytest.raises(PlanValidationError):
            M.check_rule(rule)
    with pytest.raises(PlanValidationError):
        ColumnPlan("a", "a", sensitive=True)
    with pytest.raises(PlanValidationError):
        masked(spark, ["x"], "string", MaskingRule("nope"))


def test_projection_prunes_and_hides_pads(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as string) as s", "id * 2 as unplanned").write.parquet(f"{tmp_path}/x")
    plan = TablePlan(T, T, ("id",), (ColumnPlan("id", "key", True, MaskingRule("HASH_HMAC")), ColumnPlan("s", "s2")))
    df = M.mask(spark.read.parquet(f"{tmp_path}/x"), plan, key := M.Key.of(b"secret"))
    text = df._jdf.queryExecution().toString()
    assert df.columns == ["key", "s2"] and "unplanned" not in text.split("== Physical Plan ==")[1]
    assert key.inner not in text and key.outer not in text and "***" in repr(key)


def test_keys(monkeypatch):
    monkeypatch.setenv("SOME_KEY", base64.b64encode(b"abc").decode())
    assert M.key_from_environment("env:SOME_KEY") == b"abc"
    for ref, version in (("env:OTHER_KEY", 1), ("file:x", 1), ("env:SOME_KEY", 2)):
        with pytest.raises(ConfigurationError):
            M.key_from_environment(ref, version)


def test_key_columns_need_injective_techniques():
    plan = TablePlan(T, T, ("id",), (ColumnPlan("id", "renamed", True, MaskingRule("REDACT_FULL")), ColumnPlan("x", "x")))
    for name in ("ID", "renamed"):
        with pytest.raises(PlanValidationError):
            M.validate_keys(plan, [name])
    M.validate_keys(plan, ["x", "unknown"])


def test_rules(spark):
    from veilshift.functions import rules as R

    rows = ["123-45-6789", " 123-45-6789\t", "123-45-6789\n", "x123-45-6789", "a@b.co", "a@b", "(555) 010-0001", "94107", "94107-1234", "A12345678", "4111 1111 1111 1111", "4111111111111112", "", "  ", None]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = {r.rule: (r.n, r.rate) for r in R.profile(df).collect()}
    assert got == {"US_SSN": (12, 3 / 12), "EMAIL": (12, 1 / 12), "PHONE_US": (12, 1 / 12), "US_ZIP": (12, 2 / 12), "PASSPORT_GENERIC": (12, 1 / 12), "CREDIT_CARD": (12, 1 / 12)}
    assert R.profile(df.limit(0)).count() == 0
    assert R.verdicts(R.profile(df.filter(F.col("v").like("%@%")))).first().sensitive
