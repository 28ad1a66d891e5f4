"""Scans: keyset pages, drains and head samples as plain plans that push down to the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ConnectorError


def after(keys: list[str], last: dict) -> Column | None:
    """Rows after a position in key order: k1 > a, or k1 = a and k2 > b, and so on; no position: all."""
    if not last:
        return None
    if any(last.get(k) is None for k in keys):
        raise ConnectorError("a position holds a value for every key column")
    terms = []
    for i, k in enumerate(keys):
        same = [F.col(c) == F.lit(last[c]) for c in keys[:i]]
        terms.append(reduce(Column.__and__, same, F.col(k) > F.lit(last[k])))
    return reduce(Column.__or__, terms)


def page(df: DataFrame, keys: list[str], last: dict | None = None, size: int = 5000) -> DataFrame:
    """The next page in key order: a top-n over the scan, with the position pushed down."""
    if not keys:
        raise ConnectorError("a page needs a primary key")
    where = after(keys, last or {})
    return (df if where is None else df.filter(where)).orderBy(*keys).limit(size)


def drain(df: DataFrame) -> DataFrame:
    """All pages. A scan is already split by files; there is no loop."""
    return df


def head_sample(df: DataFrame, keys: list[str], size: int = 20) -> DataFrame:
    """The first rows in key order, which the pattern rules look at; not a random sample."""
    return page(df, keys, None, size)


def limit_clause(engine: str, size: int) -> str:
    match engine:
        case "oracle":
            return f"FETCH FIRST {size} ROWS ONLY"
        case "sqlserver":
            return f"OFFSET 0 ROWS FETCH NEXT {size} ROWS ONLY"
    return f"LIMIT {size}"
