"""Continuous copy: a stream of rows through the same masking projection, upserted by micro-batch.

The upsert is idempotent, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.masking import Key, mask
from ..model import TablePlan


def masked_stream(spark: SparkSession, folder: str, schema, plan: TablePlan, key: Key, kind: str = "parquet", only: str | None = None) -> DataFrame:
    """only: a pattern of file names in the folder."""
    reader = spark.readStream.schema(schema).format(kind)
    return mask((reader.option("pathGlobFilter", only) if only else reader).load(folder), plan, key)


def copy(rows: DataFrame, destination, plan: TablePlan, checkpoint: str, available_now: bool = True):
    """Start the query; available_now: stop when what is there has been copied."""

    def upsert(batch: DataFrame, _: int) -> None:
        destination.upsert(batch, plan.destination, list(plan.destination_key))

    writer = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
