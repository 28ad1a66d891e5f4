"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Rows are range-partitioned by key within their source: a range is a
(source, bucket) pair, as keys are uniform the buckets of a source are even, and a hot source is spread
over all of them. Prefix sums over the sums of ranges find the range in which a source's exact budget ends, prefix sums
inside that range the row, so no task holds a source. Whole passes over the source come first; then every row is
compared with its source's cut: those before it are taken, the one at the cut in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, column, documents, keep, n_words, small, whole_row, width

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
SEED = "mix"
#: Ranges of each source for every shuffle partition.
RANGES = 4
#: Hex digits of a key that choose its range.
DIGITS = 8


def _source_key(source: Column) -> Column:
    """A non-null key in the same order as the sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("z"))


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """totals: (mx_source, mx_source_size), a row for each source. Adds mx_target.

    Targets are proportional to the weights, but stop at `passes` times the source's size; the excess goes to
    the others by weight. Sources are capped in the order of cap / weight: with the first k capped, the level
    of the others is (all - their caps) / (weights left); the first source below its cap fixes the level.
    """
    every, by_name = Window.partitionBy(), Window.orderBy("mx_source")
    up = Window.orderBy(F.col("mx_cap") / F.col("mx_w"), "mx_source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onwards = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("mx_w", weight).withColumn("mx_cap", F.col("mx_source_size") * F.lit(float(passes)))
    t = t.withColumn("mx_all", F.sum("mx_source_size").over(every) * F.lit(share))
    t = t.withColumns({
        "mx_pos": F.row_number().over(up),
        "mx_level": (F.col("mx_all") - F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0))) / F.sum("mx_w").over(onwards),
    })
    is_open = F.col("mx_cap") > F.col("mx_level") * F.col("mx_w")
    t = t.withColumns({
        "mx_open": F.min(F.when(is_open, F.col("mx_pos"))).over(every),
        "mx_at": F.min_by(F.when(is_open, F.col("mx_level")), F.when(is_open, F.col("mx_pos"))).over(every),
    })
    target = F.when(F.col("mx_open").isNull() | (F.col("mx_pos") < F.col("mx_open")), F.col("mx_cap")).otherwise(F.col("mx_at") * F.col("mx_w"))
    return t.select("mx_source", "mx_source_size", target.alias("mx_target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *carry: Column) -> DataFrame:
    """mx_source, mx_at (key, id and size, in this order), mx_range, and carry, of each row."""
    ranges = RANGES * width(docs.sparkSession)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(*carry, _source_key(column(source_col)).alias("mx_source"), F.struct(key.alias("key"), column(id_col).alias("id"), n_words(column(text_col)).alias("size")).alias("mx_at"))
    bucket = F.floor(F.conv(F.substring("mx_at.key", 1, DIGITS), 16, 10).cast("double") * ranges / float(16**DIGITS)).cast("int")
    return rows.withColumn("mx_range", bucket)


def _cuts(sized: DataFrame, weights, share: float, passes: int) -> DataFrame:
    """A row for each source: mx_source, mx_source_size, mx_target, mx_passes (over the whole source), mx_cut (the mx_at
    that the budget ends in; null: it ends with a pass), mx_left (words to take there) and mx_alike (rows of that mx_at).

    Sums of ranges tell the range that holds the cut, prefix sums inside that range alone the row. Rows of one mx_at are
    one there, so repeated ids make no range hot."""
    sums = keep(sized.groupBy("mx_source", "mx_range").agg(F.sum("mx_at.size").alias("mx_sum")), "mix-sums")
    targets = source_targets(sums.groupBy("mx_source").agg(F.sum("mx_sum").alias("mx_source_size")), weights, share, passes)
    whole = F.when(F.col("mx_source_size") > 0, F.expr("cast(floor(mx_target) as bigint) div mx_source_size")).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("mx_passes", whole).withColumn("mx_rest", F.floor("mx_target").cast("long") - F.col("mx_passes") * F.col("mx_source_size"))
    targets = keep(targets, "mix-targets")
    earlier = Window.partitionBy("mx_source").orderBy("mx_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("mx_source", "mx_range", "mx_sum", F.coalesce(F.sum("mx_sum").over(earlier), F.lit(0)).alias("mx_start"))
    ending = starts.join(targets.select("mx_source", "mx_rest"), "mx_source").filter("mx_start < mx_rest and mx_rest <= mx_start + mx_sum")
    ending = keep(ending.select("mx_source", "mx_range", (F.col("mx_rest") - F.col("mx_start")).alias("mx_rest")), "mix-ending")
    inside = sized.join(small(ending), ["mx_source", "mx_range"]).groupBy("mx_source", "mx_rest", "mx_at").agg(F.count("*").alias("mx_alike"))
    words = F.col("mx_alike") * F.col("mx_at.size")
    upto = F.sum(words).over(Window.partitionBy("mx_source").orderBy("mx_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("mx_upto", upto).withColumn("mx_left", F.col("mx_rest") - F.col("mx_upto") + words).filter("mx_left > 0 and mx_upto >= mx_rest")
    cut = cut.select("mx_source", F.col("mx_at").alias("mx_cut"), "mx_left", "mx_alike")
    return keep(targets.drop("mx_rest").join(cut, "mx_source", "left"), "mix-cuts")


def _part(index: Column, size: Column) -> Column:
    """Words that a row takes of mx_left, which several rows of one size share: the row's number among them, from 0 on."""
    return F.greatest(F.lit(0), F.least(size, F.col("mx_left") - index * size)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES, seed: str = SEED) -> DataFrame:
    """One row for each row of docs:

    mx_id, mx_size (words of the text), mx_source_size, mx_target (its source's), mx_taken (words the mix takes,
    repeats counted), mx_passes (times that the whole text is taken), mx_part (words of the text that one more
    pass takes; 0: none).

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last. Null ids: one key. Repeated rows:
    rows with equal keys are ordered by id and size; rows that agree in both are alike, and any of them is taken first.
    A source without words has target 0. No rows: no rows. Other columns, whatever their names, aren't looked at.
    """
    sized = keep(_sized(docs, id_col, text_col, source_col, seed), "mix")  # else counted several times
    cuts = _cuts(sized, weights, share, passes)
    rows = sized.join(small(cuts), "mx_source")
    part = F.when(F.col("mx_cut").isNull() | (F.col("mx_at") > F.col("mx_cut")), F.lit(0)).when(F.col("mx_at") < F.col("mx_cut"), F.col("mx_at.size")).otherwise(_part(F.lit(0), F.col("mx_at.size")))
    several = F.coalesce((F.col("mx_alike") > 1) & F.col("mx_at").eqNullSafe(F.col("mx_cut")), F.lit(False))
    one = rows.filter(~several).withColumn("mx_part", part.cast("long"))
    # rows alike at a cut: as many as there are, numbered. Fields are taken out of structs before rows are multiplied
    names = ["mx_source_size", "mx_target", "mx_passes"]
    many = cuts.filter("mx_alike > 1").select(*names, "mx_left", "mx_alike", F.col("mx_cut.id").alias("mx_id"), F.col("mx_cut.size").alias("mx_size"))
    many = _repeated(many, F.col("mx_alike")).withColumn("mx_part", _part(F.col("mx_number"), F.col("mx_size")))
    flat = one.select(F.col("mx_at.id").alias("mx_id"), F.col("mx_at.size").alias("mx_size"), *names, "mx_part")
    every = flat.unionByName(many.select(*flat.columns))
    return every.select("mx_id", "mx_size", "mx_source_size", "mx_target", (F.col("mx_passes") * F.col("mx_size") + F.col("mx_part")).alias("mx_taken"), "mx_passes", "mx_part")


#: Repeats of a row that one array holds.
BLOCK = 10_000


def _repeated(rows: DataFrame, n: Column) -> DataFrame:
    """Each row n times, and mx_number from 0 on; n in blocks, so that no array grows with it."""
    last = F.expr(f"(mx_n_rows - 1) div {BLOCK}")
    blocks = rows.withColumn("mx_n_rows", n.cast("long")).filter("mx_n_rows > 0").withColumn("mx_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    end = F.least((F.col("mx_block") + 1) * BLOCK, F.col("mx_n_rows")) - 1
    return blocks.withColumn("mx_number", F.explode(F.sequence(F.col("mx_block") * BLOCK, end)))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass that takes a document; the last pass over a
    source cuts one text after its last taken word. Documents without words take nothing from a budget and stay once.
    Nulls, ties, repeated rows and other columns: as for mix. Every row is judged by its source's cut, so no text is
    shuffled but those of rows alike at a cut, of which each is sent once, with their number."""
    sized = _sized(docs, id_col, text_col, source_col, seed, whole_row(docs).alias("mx_row"))
    cuts = small(_cuts(keep(_sized(docs, id_col, text_col, source_col, seed), "mix"), weights, share, passes))
    rows = sized.join(cuts, "mx_source").drop("mx_range")
    several = F.coalesce((F.col("mx_alike") > 1) & F.col("mx_at").eqNullSafe(F.col("mx_cut")), F.lit(False))
    at_cut = F.when(F.col("mx_cut").isNull() | (F.col("mx_at") > F.col("mx_cut")), F.lit(0)).when(F.col("mx_at") < F.col("mx_cut"), F.col("mx_at.size")).otherwise(_part(F.lit(0), F.col("mx_at.size")))
    one = rows.filter(~several).withColumn("mx_part", at_cut.cast("long")).withColumn("mx_times", F.lit(1).cast("long"))

    # rows alike at a cut: equal rows are one with a number; of those that a source has, so many are taken whole, one in part
    kept = ["mx_source", "mx_at", "mx_left", "mx_passes"]
    alike = rows.filter(several).groupBy(*kept, F.md5(F.to_json("mx_row").cast("binary")).alias("mx_same")).agg(F.first("mx_row").alias("mx_row"), F.count("*").alias("mx_times"))
    before = F.sum("mx_times").over(Window.partitionBy("mx_source").orderBy("mx_same").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("mx_times")
    full = F.greatest(F.lit(0), F.least(F.col("mx_times"), F.expr("mx_left div mx_at.size") - F.col("mx_before"))).cast("long")
    alike = alike.withColumn("mx_before", before).withColumn("mx_full", full)
    cut = F.when((F.expr("mx_left div mx_at.size") >= F.col("mx_before")) & (F.expr("mx_left div mx_at.size") < F.col("mx_before") + F.col("mx_times")), F.expr("mx_left % mx_at.size")).otherwise(F.lit(0)).cast("long")
    kinds = F.array(
        F.struct(F.col("mx_at.size").alias("part"), F.col("mx_full").alias("times")),
        F.struct(cut.alias("part"), F.when(cut > 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("times")),
        F.struct(F.lit(0).cast("long").alias("part"), (F.col("mx_times") - F.col("mx_full") - F.when(cut > 0, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("times")),
    )
    alike = alike.withColumn("x", F.explode(kinds)).filter("x.times > 0").withColumn("mx_part", F.col("x.part")).withColumn("mx_times", F.col("x.times"))

    names = ["mx_row", "mx_at", "mx_passes", "mx_part", "mx_times"]
    every = one.select(*names).unionByName(alike.select(*names))
    size, at = F.col("mx_size"), f"mx_c{docs.columns.index(text_col)}"
    # fields are taken out of structs before rows are multiplied
    flat = every.select(*[F.col("mx_row").getField(c).alias(f"mx_c{k}") for k, c in enumerate(docs.columns)], F.col("mx_at.size").alias("mx_size"), *names[2:])
    partly = (F.col("mx_part") > 0) & (F.col("mx_part") < size)
    whole = F.when(size == 0, F.lit(1)).otherwise(F.col("mx_passes") + (F.col("mx_part") == size).cast("long"))
    counts = F.array(F.struct(F.lit(False).alias("cut"), (F.col("mx_times") * whole).cast("long").alias("n")), F.struct(F.lit(True).alias("cut"), F.when(partly, F.col("mx_times")).otherwise(F.lit(0)).cast("long").alias("n")))
    pieces = flat.withColumn("mx_piece", F.explode(counts)).withColumns({"mx_cut": F.col("mx_piece.cut"), "mx_n": F.col("mx_piece.n")}).drop("mx_piece")
    rows = _repeated(pieces, F.col("mx_n"))
    words = F.regexp_extract_all(F.col(at), F.lit(f"({WORD})"), F.lit(1))
    text = F.when(F.col("mx_cut"), F.array_join(F.slice(words, F.lit(1), F.col("mx_part").cast("int")), " ")).otherwise(F.col(at))
    return rows.select(*[(text if c == text_col else F.col(f"mx_c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        F.col("mx_id").alias("doc_id"), F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"), F.col("mx_taken").alias("taken"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('v' || source, 'z') AS s, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(cast(doc_id AS varchar), '')) AS k
  FROM documents),
t AS (SELECT s, sum(size)::double AS ss, row_number() OVER (ORDER BY s) AS n FROM d GROUP BY s),
w AS (SELECT s, ss, 2.0::double * ss AS cap, (CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::double AS w, (sum(ss) OVER ()) * 1.5::double AS total FROM t),
l AS (
  SELECT *, row_number() OVER up AS pos,
         (total - coalesce(sum(cap) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double)) / sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW up AS (ORDER BY cap / w, s)),
o AS (SELECT min(pos) AS open, arg_min(level, pos) AS at FROM l WHERE cap > level * w),
g AS (SELECT s, ss::bigint AS ss, CASE WHEN o.open IS NULL OR pos < o.open THEN cap ELSE o.at * w END AS target FROM l, o),
p AS (
  SELECT d.*, g.ss, g.target, floor(g.target)::bigint AS budget,
         sum(size) OVER (PARTITION BY d.s ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS b
  FROM d JOIN g ON d.s = g.s),
q AS (SELECT *, CASE WHEN ss > 0 THEN budget // ss ELSE 0 END AS passes FROM p)
SELECT doc_id, size::bigint AS size, ss AS source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * ss - b)))::bigint AS taken
FROM q
"""
