"""Length, alignment and boundary statistics of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.numbers import exclusive_iqr

#: Length buckets in tokens; the last is open. Their names are fixed values.
BUCKETS = ((1, 2, "1-2"), (3, 5, "3-5"), (6, 10, "6-10"), (11, 20, "11-20"), (21, None, "21-+"))


def length_bucket(n: Column) -> Column:
    out = F.lit("other")
    for low, high, name in reversed(BUCKETS):
        out = F.when((n >= low) if high is None else n.between(low, high), F.lit(name)).otherwise(out)
    return out


def exact_quartiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exclusive-method IQR of whole numbers by group, from counts of values, so that no group is gathered row by row.

    Null for groups of fewer than four.
    """
    from pyspark.sql.window import Window as W

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0) if by else W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    counts = counts.withColumns({"upto": F.sum("c").over(run), "n": F.sum("c").over(whole)})
    picks = {}
    for k in (1, 3):
        j = F.least(F.greatest(F.floor(F.lit(k) * (F.col("n") + 1) / 4), F.lit(1)), F.col("n") - 1)
        at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v"))).cast("double")
        rest = F.max(F.lit(k) * (F.col("n") + 1) - j * 4)
        picks[k] = (at(j) * (4 - rest) + at(j + 1) * rest) / 4
    return counts.groupBy(*by).agg(F.when(F.max("n") >= 4, picks[3] - picks[1]).alias("iqr"))


def length_stats(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, min, max, median, mean, cv and exclusive IQR of a whole-number length, by group or overall."""
    by = by or []
    one = rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), F.avg(value).alias("mean"),
        F.when(F.avg(value) != 0, F.stddev_pop(value) / F.avg(value)).alias("cv"),
    )
    spread = exact_quartiles(rows, value, by)
    return one.join(spread, by, "left") if by else one.crossJoin(F.broadcast(spread))  # one row each


def array_iqr(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The same by gathering values: only for groups that are small by nature."""
    return rows.groupBy(*by).agg(exclusive_iqr(F.collect_list(value)).alias("iqr"))


def bucket_counts(rows: DataFrame, n: str) -> DataFrame:
    """Rows of every bucket, empty ones included, and of ``other`` if there are any."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(name,) for _, _, name in BUCKETS], "bucket string")
    found = rows.select(length_bucket(F.col(n)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("c"))
    return names.join(found, "bucket", "full").select("bucket", F.coalesce("c", F.lit(0)).alias("count"))


def bucket_shares(rows: DataFrame, n: str, label: str) -> DataFrame:
    """Per label, the share of each bucket."""
    b = length_bucket(F.col(n))
    return rows.groupBy(label).agg(*[F.avg((b == name).cast("double")).alias(f"share_{name}") for _, _, name in BUCKETS])


def relation_shares(rows: DataFrame, relation: str) -> DataFrame:
    """Counts and shares of the four relations, those that don't occur included."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in ("aligned", "inside", "crosses", "outside")], f"{relation} string")
    counts = names.join(rows.groupBy(relation).agg(F.count("*").alias("c")), relation, "left").select(relation, F.coalesce("c", F.lit(0)).alias("count"))
    whole = counts.agg(F.sum("count").alias("__t"))
    return counts.crossJoin(F.broadcast(whole)).select(relation, "count", F.when(F.col("__t") > 0, F.col("count") / F.col("__t")).otherwise(0.0).alias("share"))


def boundary_stats(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Mean and median tokens to the left, to the right, and of both together."""
    sides = rows.select(F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col(left).alias("v")), F.struct(F.lit("right").alias("side"), F.col(right).alias("v")))).alias("x")).select("x.*")
    both = sides.withColumn("side", F.lit("overall")).unionByName(sides)
    return both.groupBy("side").agg(F.avg("v").alias("mean"), F.median("v").alias("median"))
