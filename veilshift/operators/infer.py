"""Schema inference for documents: a majority vote on the JSON type of every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 1000


def label(kind: Column) -> Column:
    """The document store's type name for a JSON value's type."""
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "BIGINT", "int64").when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "double").when(kind == "VOID", "null").otherwise("string")
    )


def infer(docs: DataFrame, column: str, sample: int | None = SAMPLE) -> DataFrame:
    """field, type, votes, nullable of the documents in a JSON column.

    A field's type is its most frequent one (ties: the first by name); nulls don't vote, and a field of nothing else is
    a string. It is nullable if it is missing or null in some document. sample: so many documents, none: all.
    """
    rows = docs.select(F.col(column).alias("j")).filter("j is not null")
    rows = rows if sample is None else rows.limit(sample)
    parsed = rows.select(F.try_parse_json("j").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    each = parsed.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
    votes = each.select(F.col("key").alias("field"), label(F.schema_of_variant("value")).alias("type")).groupBy("field", "type").agg(F.count("*").alias("votes"))
    documents = parsed.count()
    order = Window.partitionBy("field").orderBy((F.col("type") == "null").cast("int"), F.col("votes").desc(), "type")
    top = votes.select("*", F.row_number().over(order).alias("rank"), F.sum(F.when(F.col("type") != "null", F.col("votes")).otherwise(0)).over(Window.partitionBy("field")).alias("present")).filter("rank = 1")
    return top.select("field", F.when(F.col("type") == "null", "string").otherwise(F.col("type")).alias("type"), "votes", (F.col("present") < documents).alias("nullable"))
