"""Helpers that the operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what separates words: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        sc = spark.sparkContext
        own = sc._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else ""
        if not found:
            found = tempfile.mkdtemp(prefix="veilshift-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors.

    large: what was shuffled for it is worth freeing at once; Spark frees it when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if large:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Delete a kept table that no later step reads."""
    spark = kept.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def thrifty(batches):
    """Arrow batches, with the memory of each given back to the system before the next: workers live on between tasks,
    and several of them share an executor's memory."""
    import ctypes

    import pyarrow as pa

    try:
        libc = ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        libc = None
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)


def slices(batches, rows: int = 512):
    """Arrow batches in slices of so many rows, so that few of their texts are Python's at once; memory goes back after each batch."""
    for batch in thrifty(batches):
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def column(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """A row's columns as one struct: so the names that an operator adds can't clash with them."""
    return F.struct(*[column(c) for c in df.columns])


def unfolded(df: DataFrame, row: str, names: list[str], **other: Column) -> DataFrame:
    """The columns that whole_row has folded, those of other in their places."""
    return df.select(*[other.get(c, F.col(row).getField(c)).alias(c) for c in names])


#: Rows of a small table that is broadcast.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A kept table, marked to be broadcast if it has at most so many rows; else it is joined as it is."""
    return F.broadcast(df) if df.count() <= most else df


def n_words(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
