"""Upsert by natural key over files: merge on the key, write beside the table, swap.

Relational tables keep what a row doesn't supply and never match null keys; document tables replace whole rows and
match null with null. Rows are never deleted; a repeated run changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import ConnectorError


#: Names of columns that a run adds to order rows of one key by, the source's primary key.
ORDER = "__order_"


@dataclass(frozen=True)
class Upserted:
    inserted: int
    updated: int

    def __add__(self, other: Upserted) -> Upserted:
        return Upserted(self.inserted + other.inserted, self.updated + other.updated)


def last_of_each(df: DataFrame, key: list[str], order: list[str] | None, null_safe: bool = False) -> DataFrame:
    """Of rows with one key the last in `order`. Rows with a null in the key are all kept, as they match nothing. Columns
    whose names begin with ORDER only order the rows, and go."""
    if not key:
        raise ConnectorError("an upsert needs a natural key")
    by = [F.col(c).desc() for c in (order or key)] + [F.xxhash64(*df.columns).desc()]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    first = F.col("__rank") == 1
    if not null_safe:
        first = first | reduce(Column.__or__, [F.col(k).isNull() for k in key])
    return ranked.filter(first).drop("__rank", *[c for c in df.columns if c.startswith(ORDER)])


def merge(existing: DataFrame, incoming: DataFrame, key: list[str], document: bool = False, order: list[str] | None = None) -> DataFrame:
    """The table after the upsert, with `__change`: kept, inserted or updated. One full join on the key."""
    new = last_of_each(incoming, key, order, null_safe=document)
    columns = [*existing.columns, *[c for c in new.columns if c not in existing.columns]]
    a = existing.withColumn("__old", F.lit(1)).alias("a")
    b = new.withColumn("__new", F.lit(1)).alias("b")
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) if document else F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in key]
    both = a.join(b, reduce(Column.__and__, same), "full")
    out = []
    for c in columns:
        old = F.col(f"a.`{c}`") if c in existing.columns else F.lit(None)
        if c in new.columns:
            out.append(F.when(F.col("b.__new") == 1, F.col(f"b.`{c}`")).otherwise(old).alias(c))
        else:
            out.append((F.when(F.col("b.__new").isNull(), old) if document else old).alias(c))
    change = F.when(F.col("b.__new").isNull(), "kept").when(F.col("a.__old").isNull(), "inserted").otherwise("updated")
    return both.select(*out, change.alias("__change"))


def counts(merged: DataFrame) -> Upserted:
    r = merged.agg(F.count_if(F.col("__change") == "inserted"), F.count_if(F.col("__change") == "updated")).first()
    return Upserted(r[0], r[1])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def recover(spark: SparkSession, path: str) -> None:
    """What a swap that was broken off left: the old table comes back if there is none, else its remains go."""
    fs, target = _fs(spark, path)
    parent = target.getParent()
    if not fs.exists(parent):
        return
    old = [f.getPath() for f in fs.listStatus(parent) if f.getPath().getName().startswith(f"{target.getName()}.old-")]
    if not old:
        return
    if not fs.exists(target):
        if not fs.rename(old[0], target):
            raise ConnectorError(f"{path} couldn't be recovered")
        old = old[1:]
    for x in old:
        fs.delete(x, True)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put a staged table in a table's place; the old one goes last. Between the two renames the table isn't there; a
    crash there is mended by recover, which every run's look at a file table and every upsert begin with."""
    fs, target = _fs(spark, path)
    fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (staged, f"{path}.old-{uuid.uuid4().hex}"))
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise ConnectorError(f"{path} couldn't be replaced")
    if had:
        fs.delete(old, True)


def stage_files(df: DataFrame, path: str, key: list[str], kind: str = "parquet", order=None, document: bool = False) -> tuple[str | None, Upserted]:
    """Write the merged table beside `path`; (None, no counts) for an empty input."""
    spark = df.sparkSession
    recover(spark, path)
    if df.isEmpty():
        return None, Upserted(0, 0)
    staged = f"{path}.new-{uuid.uuid4().hex}"
    if path_exists(spark, path):
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        merged = merge(reader.format(kind).load(path), df, key, document, order)
    else:
        merged = last_of_each(df, key, order, document).withColumn("__change", F.lit("inserted"))
    seen = {c: F.count_if(F.col("__change") == c).alias(c) for c in ("inserted", "updated")}
    from pyspark.sql import Observation

    o = Observation()
    writer = merged.observe(o, *seen.values()).drop("__change").write.format(kind)
    (writer.option("header", True) if kind == "csv" else writer).save(staged)
    got = o.get
    return staged, Upserted(got["inserted"], got["updated"])


def upsert_files(df: DataFrame, path: str, key: list[str], kind: str = "parquet", order=None, document: bool = False) -> Upserted:
    staged, done = stage_files(df, path, key, kind, order, document)
    if staged:
        swap(df.sparkSession, staged, path)
    return done
