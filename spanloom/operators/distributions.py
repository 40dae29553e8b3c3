"""Counts, imbalance and coverage of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def label_counts(rows: DataFrame, label: str | Column = "label") -> DataFrame:
    label = F.col(label) if isinstance(label, str) else label
    return rows.select(label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("count"))


def most_common(rows: DataFrame, label: str, order: str, n: int | None = None) -> DataFrame:
    """Counts in descending order, ties by first occurrence in ``order``."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"), F.min(order).alias("first"))
    ordered = counts.orderBy(F.desc("count"), "first", "label")
    return ordered.limit(n) if n else ordered


def imbalance(counts: DataFrame) -> DataFrame:
    """One row of metrics over (label, count); all but k and total are null when there are none.

    CV is over the population; H is in nats with 1e-12 added inside the logarithm.
    """
    whole = counts.agg(F.sum("count").alias("t"))
    rows = counts.crossJoin(F.broadcast(whole)).select("count", (F.col("count") / F.col("t")).alias("p"))  # one row
    stats = rows.agg(
        F.count("*").alias("k"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"), (F.max("count") / F.min("count")).alias("ir_max"), (F.stddev_pop("count") / F.avg("count")).alias("cv"),
        (-F.sum(F.col("p") * F.log(F.col("p") + EPSILON))).alias("h"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.max("count").alias("max_count"), F.min("count").alias("min_count"),
    )
    h_norm = F.when(F.col("k") > 1, F.col("h") / F.log(F.col("k").cast("double"))).when(F.col("k") == 1, F.lit(0.0))
    return stats.select("k", "total", "ir_max", "cv", "h", h_norm.alias("h_norm"), (1 - F.col("pp")).alias("gini"), (1 / F.col("pp")).alias("n_eff"), "max_count", "min_count")


def compare_types(parts: dict[str, DataFrame]) -> DataFrame:
    """Metric rows of several distributions under one another."""
    out = None
    for name, counts in parts.items():
        row = imbalance(counts).withColumn("type", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def path_coverage(rows: DataFrame, levels: Sequence[str], item: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Distinct items and rows for each path of the given level combinations, in one pass of grouping sets."""
    names = ", ".join(f"`{x}`" for x in levels)
    groups = ", ".join("(" + ", ".join(f"`{x}`" for x in s) + ")" for s in sets)
    spark = rows.sparkSession
    return spark.sql(
        f"SELECT {names}, count(DISTINCT `{item}`) AS coverage, count(*) AS frequency, CAST(grouping_id({names}) AS BIGINT) AS level_bits FROM {{rows}} GROUP BY GROUPING SETS ({groups})", rows=rows
    )


def unmapped(rows: DataFrame, label: str, known: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` distinct labels, sorted, that ``known`` lacks."""
    keys = known.select(F.col(known.columns[0]).alias("label")).distinct()
    return rows.select(F.col(label).alias("label")).distinct().join(keys, "label", "left_anti").orderBy("label").limit(n)


def cross_tab(rows: DataFrame, row: str, column: str, top_rows: int = 20, top_columns: int = 30) -> DataFrame:
    """Dense counts of the most frequent rows by the most frequent columns, 0 where there is none."""
    tops = lambda c, n: [r[0] for r in rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(n).collect()]
    keep, values = tops(row, top_rows), tops(column, top_columns)
    return rows.where(F.col(row).isin(keep)).groupBy(row).pivot(column, values).count().na.fill(0)


def percent(rows: DataFrame, label: str) -> DataFrame:
    counts = label_counts(rows, label)
    whole = counts.agg(F.sum("count").alias("__t"))
    return counts.crossJoin(F.broadcast(whole)).select("label", "count", (F.col("count") * 100.0 / F.col("__t")).alias("percent"))


def per_unit_histogram(units: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """How many units have n matches, those with none included."""
    n = matches.groupBy(key).agg(F.count("*").alias("n"))
    joined = units.select(key).join(n, key, "left").select(F.coalesce("n", F.lit(0)).alias("n_matches"))
    return joined.groupBy("n_matches").agg(F.count("*").alias("n_units"))


def with_frequencies(codebook: DataFrame, counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Codebook rows with their frequencies, 0 where they don't occur."""
    return codebook.join(counts, list(on), "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def duplicates_collapsed(rows: DataFrame, parent: str, label: str, order: str) -> DataFrame:
    """Old order, kept order and new 1-based index of each row; of one parent and label the first stays."""
    from pyspark.sql.window import Window as W

    first = rows.groupBy(parent, label).agg(F.min(order).alias("kept"))
    index = first.withColumn("new_index", F.row_number().over(W.partitionBy(parent).orderBy("kept")))
    return rows.select(parent, label, order).join(index, [parent, label]).select(parent, label, order, "kept", "new_index")


def flag_combinations(rows: DataFrame, flags: Sequence[str], by: str | None = None) -> DataFrame:
    """Counts of each combination of set flags, joined by +."""
    combo = F.array_join(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags])), "+")
    keys = [combo.alias("combo"), *([F.col(by)] if by else [])]
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))
