"""Pattern rules that tell sensitive columns, and the profile of a table under them in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns; a value has to match as a whole.
PATTERNS = {
    "US_SSN": r"\d{3}-\d{2}-\d{4}",
    "EMAIL": r"[^@\s]+@[^@\s]+\.[^@\s]+",
    "PHONE_US": r"\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}",
    "US_ZIP": r"\d{5}(-\d{4})?",
    "PASSPORT_GENERIC": r"[A-Z]\d{8}",
}
CARD = "CREDIT_CARD"
RULES = (*PATTERNS, CARD)
THRESHOLD = 0.5


def trimmed(s: Column) -> Column:
    """Without control characters and spaces at both ends."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def matches(s: Column, rule: str) -> Column:
    """Whether a trimmed string matches the rule."""
    if rule == CARD:
        digits = F.regexp_replace(s, r"[\s-]", "")
        return digits.rlike(r"^[0-9]{13,19}\z") & F.call_function("luhn_check", F.when(digits.rlike(r"^[0-9]{13,19}\z"), digits).otherwise("1"))
    return s.rlike(rf"^(?:{PATTERNS[rule]})\z")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rule, n (values that aren't null or blank), rate: rows with a rate over 0. One pass over df, one row shuffled
    for each task."""
    columns = columns or df.columns
    values = {c: trimmed(F.col(f"`{c}`").cast("string")) for c in columns}
    aggregates = []
    for i, c in enumerate(columns):
        v = values[c]
        v = F.when(v != "", v)
        aggregates.append(F.count(v).alias(f"n{i}"))
        aggregates += [F.count_if(F.coalesce(matches(v, r), F.lit(False))).alias(f"m{i}_{k}") for k, r in enumerate(RULES)]
    one = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"n{i}").alias("n"), F.try_divide(F.col(f"m{i}_{k}").cast("double"), F.col(f"n{i}").cast("double")).alias("rate")) for i, c in enumerate(columns) for k, r in enumerate(RULES)])
    return one.select(F.explode(rows).alias("x")).select("x.*").filter("rate > 0")


def verdicts(signals: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """column, max_rate, sensitive: the strongest rule of each column against the threshold."""
    return signals.groupBy("column").agg(F.max("rate").alias("max_rate")).withColumn("sensitive", F.col("max_rate") >= threshold)
