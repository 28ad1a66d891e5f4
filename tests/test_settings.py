import json

import pytest
from pyspark.sql import types as T

from veilshift.functions import corpora
from veilshift.functions import masking as M
from veilshift.model import ConfigurationError, ForeignKey, MaskingRule, TableRef
from veilshift.operators.graph import CycleRule
from veilshift.plans.config import Override, Settings


def test_settings_from_a_tree(tmp_path):
    tree = {
        "key_ref": "env:K", "confidence": 0.5, "parallelism": 2,
        "overrides": {"people": {"masking": {"ssn": {"technique": "REDACT_PARTIAL", "keep_last": 4}}, "natural_key": ["ext"], "renames": {"ssn": "s"}}},
        "virtual_keys": [{"child": "app.visits", "child_columns": ["p"], "parent": "people", "parent_columns": ["id"]}],
        "cycles": [{"tables": ["a", "b"], "strategy": "DECLARED_ORDER", "load_order": ["b", "a"]}],
    }
    want = Settings(
        "env:K", {"people": Override({"ssn": MaskingRule("REDACT_PARTIAL", keep_last=4)}, (), ("ext",), {"ssn": "s"})},
        (ForeignKey(TableRef("visits", "app"), ("p",), TableRef("people"), ("id",)),), (CycleRule(("a", "b"), "DECLARED_ORDER", ("b", "a")),), 0.5, parallelism=2,
    )
    path = tmp_path / "s.json"
    path.write_text(json.dumps(tree))
    assert Settings.of(tree) == Settings.load(str(path)) == want
    path.write_text("{")
    for bad in ({"speed": 1}, {"cycles": [{"tables": ["a"]}]}, {"overrides": {"t": {"masking": {"c": {"how": 1}}}}}, {"confidence": 2}):
        with pytest.raises(ConfigurationError):
            Settings.of(bad)
    for p in (path, tmp_path / "none.json"):
        with pytest.raises(ConfigurationError):
            Settings.load(str(p))


def test_corpora_from_files(tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("  one \n\n two\t\n")
    assert corpora.load("numbers", str(path)) == ("one", "two") == corpora.CORPORA.pop("numbers")
    path.write_text(" \n")
    for p in (path, tmp_path / "none"):
        with pytest.raises(ConfigurationError):
            corpora.load("x", str(p))


def test_a_key_is_zeroed(monkeypatch):
    monkeypatch.setenv("K", "c2VjcmV0")
    key = M.key_from_environment("env:K")
    assert key == b"secret" and M.Key.of(key) == M.Key.of(b"secret") and key == bytes(6)


def test_numbers_past_int(spark):
    big = [(2**31, 3e10, "12345678901.99"), (-(2**31) - 1, -3e10, "-7.9"), (2**32 + 42, float("nan"), "4294967295.5"), (None, None, None)]
    df = spark.createDataFrame(big, "l bigint, d double, s string").selectExpr("l", "d", "cast(s as decimal(20,2)) as m")
    rows = df.select(M.whole(df.l, T.LongType(), "l"), M.whole(df.d, T.DoubleType(), "d"), M.whole(df.m, T.DecimalType(20, 2), "m")).collect()
    wrap = lambda n: (n + 2**31) % 2**32 - 2**31
    assert [tuple(r) for r in rows] == [(-(2**31), 2**31 - 1, wrap(12345678901)), (2**31 - 1, -(2**31), -7), (42, 0, -1), (None, None, None)]
