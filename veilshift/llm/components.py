"""Connected components of a table of links, by alternating large and small stars.

Links stay a table all along: each round writes it to the shared folder, nothing but its size and a checksum comes to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, keep

#: Rounds; links halve their depth in each, so no graph needs so many.
ROUNDS = 100


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The kept table, and its size and checksum, taken as it is written."""
    o = Observation()
    seen = links.observe(o, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    table = keep(seen, "links")
    return table, (o.get["n"], o.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """links: u, v (bigint). Returns u, v: every linked node but the smallest of its component, with that smallest one."""
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, before = _kept(e)
    for _ in range(ROUNDS):
        if not before[0]:
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        last = e
        e, after = _kept(small.filter("u <> v").distinct())
        discard(last)
        if after == before:
            return e
        before = after
    raise RuntimeError("components don't settle")
