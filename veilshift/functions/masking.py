"""Masking techniques as column expressions: no UDF, so they stay inside whole-stage code generation.

A keyed hash is HMAC-SHA-256 written as two nested sha2 over the key's inner and outer pads. Pads are literals and as
secret as the key; `hide_secrets` keeps long hex literals out of plans.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CanonicalType, ConfigurationError, Kind, MaskingRule, PlanValidationError, TablePlan
from .corpora import CORPORA

REDACTION = r"(?i)[0-9a-f]{64,}"
BLOCK = 64


def hide_secrets(spark: SparkSession) -> None:
    """Plans print string literals; from now on this session blanks those as long as a pad."""
    spark.conf.set("spark.sql.redaction.string.regex", REDACTION)


def key_from_environment(ref: str, version: int = 1, current: int = 1) -> bytearray:
    """ref: env:NAME, whose value is the key in base64. Key.of blanks it."""
    if version != current:
        raise ConfigurationError(f"masking key version {version} isn't there")
    kind, _, name = ref.partition(":")
    if kind != "env" or not (value := os.environ.get(name)):
        raise ConfigurationError("the masking key isn't set")
    return bytearray(base64.b64decode(value))


@dataclass(frozen=True)
class Key:
    """A masking key as the two pads of HMAC; never printed."""

    inner: str
    outer: str

    def __repr__(self) -> str:
        return "Key(***)"

    @staticmethod
    def of(key: bytes | bytearray) -> Key:
        """A key in a bytearray is zeroed once its pads are made."""
        if not key:
            raise ConfigurationError("the masking key is empty")
        block = (hashlib.sha256(key).digest() if len(key) > BLOCK else bytes(key)).ljust(BLOCK, b"\0")
        if isinstance(key, bytearray):
            key[:] = bytes(len(key))
        return Key(bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex())


def canonical(c: Column, kind: T.DataType | None = None) -> Column:
    """A value as the string that is hashed. Equal integers of any width are equal strings; bytes are hex."""
    return F.lower(F.hex(c)) if isinstance(kind, T.BinaryType) else F.to_json(c) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else c.cast("string")


def hmac_hex(s: Column, key: Key) -> Column:
    inside = F.sha2(F.concat(F.unhex(F.lit(key.inner)), F.encode(s, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(key.outer)), F.unhex(inside)), 256)


def hmac_base64url(s: Column, key: Key) -> Column:
    return F.rtrim(F.translate(F.base64(F.unhex(hmac_hex(s, key))), "+/", "-_"), F.lit("="))


def redact_full(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("REDACTED"))


def redact_partial(s: Column, keep_last: int = 4) -> Column:
    """Stars for all but the last characters (code points)."""
    shown = F.least(F.lit(keep_last), F.length(s))
    return F.concat(F.repeat(F.lit("*"), F.length(s) - shown), F.when(shown > 0, F.right(s, shown)).otherwise(F.lit("")))


def _or_fail(value: Column, c: Column, what: str) -> Column:
    """value; an error that doesn't tell the value where c couldn't be converted."""
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.lit(what)).cast("int")).otherwise(value)


def year(c: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.year(c)
    return _or_fail(F.year(F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")), c, f"column {name}: not a date")


def whole(c: Column, kind: T.DataType, name: str) -> Column:
    """An age: numbers are cut to whole ones, strings parsed. Whole numbers past 32 bits keep the lowest 32, others the
    nearest that fits, and no number is 0; so no value stands in an error."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
        return c.cast("int")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(F.isnan(c), F.lit(0)).when(c.isNotNull(), F.greatest(F.least(c.cast("double"), F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int"))
    if isinstance(kind, T.NumericType):
        cut = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)) if isinstance(kind, T.DecimalType) else c
        low = F.pmod(cut, F.lit(4294967296)).cast("bigint")
        return F.when(low >= 2147483648, low - 4294967296).otherwise(low).cast("int")
    s = F.regexp_replace(c.cast("string"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return _or_fail(F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("int")), c, f"column {name}: not an integer")


def zip3(s: Column) -> Column:
    return F.substring(s, 1, 3)


def five_year_band(age: Column) -> Column:
    low = F.floor(F.abs(age) / 5).cast("int") * F.when(age < 0, F.lit(-5)).otherwise(F.lit(5))
    return F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))


def ninety_plus(age: Column) -> Column:
    return F.when(age >= 90, F.lit("90+")).otherwise(age.cast("string"))


def synthetic(s: Column, key: Key, corpus: tuple[str, ...]) -> Column:
    """The corpus entry at the digest's first eight bytes, as a signed number, modulo its size."""
    n = F.conv(F.substring(hmac_hex(s, key), 1, 16), 16, -10).cast("bigint")
    return F.when(s.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in corpus]), (F.pmod(n, F.lit(len(corpus))) + 1).cast("int")))


@dataclass(frozen=True)
class Technique:
    """build(column, its type, its name, rule, key), whether equal outputs mean equal inputs, and the masked type."""

    build: Callable[[Column, T.DataType, str, MaskingRule, Key], Column]
    injective: bool
    output: Callable[[MaskingRule], CanonicalType]


def _hash(c, kind, name, rule, key):
    s = canonical(c, kind)
    return hmac_hex(s, key) if (rule.encoding or "BASE64URL").upper() == "HEX" else hmac_base64url(s, key)


def _bucket(c, kind, name, rule, key):
    match rule.granularity.upper():
        case "YEAR":
            return year(c, kind, name)
        case "ZIP3":
            return zip3(canonical(c, kind))
        case "AGE_5YEAR_BAND":
            return five_year_band(whole(c, kind, name))
        case "AGE_90_PLUS":
            return ninety_plus(whole(c, kind, name))


def _string(n=None):
    return lambda rule: CanonicalType(Kind.STRING, n)


TECHNIQUES = {
    "HASH_HMAC": Technique(_hash, True, lambda r: CanonicalType(Kind.STRING, 64 if (r.encoding or "").upper() == "HEX" else 43)),
    "REDACT_FULL": Technique(lambda c, kind, name, rule, key: redact_full(c), False, _string(8)),
    "REDACT_PARTIAL": Technique(lambda c, kind, name, rule, key: redact_partial(canonical(c, kind), 4 if rule.keep_last is None else rule.keep_last), False, _string()),
    "GENERALIZE_BUCKET": Technique(_bucket, False, lambda r: CanonicalType(Kind.INTEGER) if (r.granularity or "").upper() == "YEAR" else CanonicalType(Kind.STRING, 16)),
    "SYNTHETIC_SUBSTITUTION": Technique(lambda c, kind, name, rule, key: synthetic(canonical(c, kind), key, CORPORA[rule.corpus or "name"]), False, _string(255)),
}
GRANULARITIES = ("YEAR", "ZIP3", "AGE_5YEAR_BAND", "AGE_90_PLUS")


def check_rule(rule: MaskingRule) -> Technique:
    """The rule's technique. What a rule lacks is told when a plan is compiled, before any row is read."""
    if rule.technique not in TECHNIQUES:
        raise PlanValidationError(f"unknown masking technique {rule.technique}")
    if rule.technique == "HASH_HMAC" and (rule.encoding or "BASE64URL").upper() not in ("HEX", "BASE64URL"):
        raise PlanValidationError(f"unknown encoding {rule.encoding}")
    if rule.technique == "GENERALIZE_BUCKET" and (rule.granularity or "").upper() not in GRANULARITIES:
        raise PlanValidationError(f"missing or unknown granularity {rule.granularity}")
    if rule.technique == "SYNTHETIC_SUBSTITUTION" and (rule.corpus or "name") not in CORPORA:
        raise PlanValidationError(f"unknown corpus {rule.corpus}")
    if rule.keep_last is not None and rule.keep_last < 0:
        raise PlanValidationError("keepLast is negative")
    return TECHNIQUES[rule.technique]


def validate_keys(plan: TablePlan, keys) -> None:
    """A masked key must stay a key: its technique has to be injective."""
    for k in keys:
        c = plan.column(k)
        if c is not None and c.sensitive and not check_rule(c.masking).injective:
            raise PlanValidationError(f"key column {k} of {plan.source.name} is masked by {c.masking.technique}, which isn't injective")


def masked_columns(schema: T.StructType, plan: TablePlan, key: Key) -> list[Column]:
    """The plan's columns in its order, masked or passed through, under their destination names."""
    types = {f.name.lower(): (f.name, f.dataType) for f in schema.fields}
    out = []
    for c in plan.columns:
        if c.source.lower() not in types:
            raise PlanValidationError(f"{plan.source.name} has no column {c.source}")
        name, kind = types[c.source.lower()]
        value = F.col(f"`{name}`")
        if c.sensitive:
            value = check_rule(c.masking).build(value, kind, name, c.masking, key)
        out.append(value.alias(c.destination))
    return out


def mask(df: DataFrame, plan: TablePlan, key: Key) -> DataFrame:
    """One projection: unplanned columns are pruned from the scan."""
    hide_secrets(df.sparkSession)
    return df.select(*masked_columns(df.schema, plan, key))
