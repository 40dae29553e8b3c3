"""k-nearest neighbours and what they say about ambiguous labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Vectors in a tile's side; a tile holds two sides, whatever the table's size.
TILE_ROWS = 2048


def knn_cosine(items: DataFrame, k: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """i, j, similarity, rank: the k nearest others of each (id, vector), ties by j; a row is never its own neighbour.

    Exact search is quadratic by definition. It runs in tiles of two bounded
    blocks, multiplied as matrices; a tile passes on only its own k best of each
    row, and those are merged by one window. Null, empty and zero vectors have
    no neighbours and are none.
    """
    rows = items.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0)")
    blocks = max(1, -(-rows.count() // tile_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = rows.select(block.alias("q"), other.alias("b"), F.lit(True).alias("ask"), "id", "v")
    base = rows.select(other.alias("q"), block.alias("b"), F.lit(False).alias("ask"), "id", "v")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        own, there = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        if not len(own) or not len(there):
            return pd.DataFrame({"i": [], "j": [], "similarity": []}).astype({"i": "int64", "j": "int64"})
        a, b = (np.stack(x["v"].to_list()).astype(float) for x in (own, there))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        i, j = own["id"].to_numpy(), there["id"].to_numpy()
        near = a @ b.T
        near[i[:, None] == j[None, :]] = -2.0
        order = np.lexsort((np.broadcast_to(j, near.shape), -near), axis=1)[:, :k]
        best = np.take_along_axis(near, order, 1).ravel()
        out = pd.DataFrame({"i": np.repeat(i, order.shape[1]), "j": j[order].ravel(), "similarity": best})
        return out[out["similarity"] > -1.5]

    found = asks.unionByName(base).groupBy("q", "b").applyInPandas(tile, "i long, j long, similarity double")
    return rank_neighbours(found, k)


def rank_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("i").orderBy(F.desc("similarity"), "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_sets(items: DataFrame, threshold: float) -> DataFrame:
    """i, j, similarity of all ordered pairs of (id, words) with a Jaccard similarity of ``threshold`` or more.

    Pairs meet on one of their rarest words: a set's first n - ceil(t n) + 1 in
    order of document frequency, one of which any such pair shares. Lengths
    prune before sets are intersected.
    """
    sets = items.select(F.col("id").cast("long").alias("id"), F.array_distinct("words").alias("words")).where("size(words) > 0")
    flat = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    df = flat.groupBy("word").agg(F.count("*").alias("df"))
    ranked = flat.join(df, "word").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("df", "word")))
    first = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).select("id", "n", "word")
    a, b = first.select(F.col("id").alias("i"), F.col("n").alias("n_i"), "word"), first.select(F.col("id").alias("j"), F.col("n").alias("n_j"), "word")
    met = a.join(b, "word").where((F.col("i") < F.col("j")) & (F.least("n_i", "n_j") >= F.lit(threshold) * F.greatest("n_i", "n_j"))).select("i", "j").distinct()
    x, y = sets.select(F.col("id").alias("i"), F.col("words").alias("x")), sets.select(F.col("id").alias("j"), F.col("words").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    pairs = met.join(x, "i").join(y, "j").withColumn("similarity", both / (F.size("x") + F.size("y") - both)).where(F.col("similarity") >= threshold)
    return pairs.select("i", "j", "similarity").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))


def sparse_cosine(terms: DataFrame, threshold: float) -> DataFrame:
    """i, j, similarity of ordered pairs of (id, term, weight) unit vectors at ``threshold`` or more.

    Vectors meet on their heaviest terms only: once the terms left out weigh too
    little to reach the threshold on their own, no pair is lost.
    """
    w = W.partitionBy("id").orderBy(F.desc("weight"), "term")
    placed = terms.withColumn("ahead", F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    heads = placed.where(1 - F.col("ahead") >= threshold * threshold - 1e-9).select("id", "term")
    met = heads.select(F.col("id").alias("i"), "term").join(terms.select(F.col("id").alias("j"), "term"), "term").where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    x, y = terms.select(F.col("id").alias("i"), "term", F.col("weight").alias("wx")), terms.select(F.col("id").alias("j"), "term", F.col("weight").alias("wy"))
    pairs = met.join(x, "i").join(y, ["j", "term"]).groupBy("i", "j").agg(F.sum(F.col("wx") * F.col("wy")).alias("similarity")).where(F.col("similarity") >= threshold)
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))


def labelled(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Neighbour pairs with the labels (id, label) of both ends; unlabelled ends drop out."""
    a, b = labels.select(F.col("id").alias("i"), F.col("label").alias("label_i")), labels.select(F.col("id").alias("j"), F.col("label").alias("label_j"))
    return neighbours.join(a, "i").join(b, "j")


def conflicts(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where((F.col("similarity") >= threshold) & (F.col("label_i") != F.col("label_j")))


def conflict_pairs(found: DataFrame) -> DataFrame:
    """Per unordered label pair: count, mean, median, largest and smallest similarity."""
    keyed = found.select(F.least("label_i", "label_j").alias("label_a"), F.greatest("label_i", "label_j").alias("label_b"), "similarity")
    s = F.col("similarity")
    return keyed.groupBy("label_a", "label_b").agg(F.count("*").alias("conflict_count"), F.avg(s).alias("mean_similarity"), F.median(s).alias("median_similarity"), F.max(s).alias("max_similarity"), F.min(s).alias("min_similarity"))


def conflict_ratios(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Conflict pairs with the sizes of both labels and the shares of them in conflict."""
    a, b = counts.select(F.col("label").alias("label_a"), F.col("count").alias("n_a")), counts.select(F.col("label").alias("label_b"), F.col("count").alias("n_b"))
    return pairs.join(a, "label_a").join(b, "label_b").withColumns({"ratio_a": F.col("conflict_count") / F.col("n_a"), "ratio_b": F.col("conflict_count") / F.col("n_b")})


def pooled_disagreement(pairs: DataFrame, labels: DataFrame, threshold: float, k: int) -> DataFrame:
    """Per label the share of disagreeing neighbours among all k of each item, near or not."""
    totals = labels.groupBy("label").agg((F.count("*") * k).alias("neighbor_total"))
    bad = conflicts(pairs, threshold).groupBy(F.col("label_i").alias("label")).agg(F.count("*").alias("d"))
    out = totals.join(bad, "label", "left").withColumn("neighbor_disagreement", F.coalesce("d", F.lit(0))).drop("d")
    return out.withColumn("disagreement_rate", F.col("neighbor_disagreement") / F.col("neighbor_total"))


def item_rates(pairs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """id, label, rate: each item's share of other labels among its neighbours that are near enough; 0 without any."""
    near = pairs.where(F.col("similarity") >= threshold).groupBy(F.col("i").alias("id")).agg(F.avg((F.col("label_i") != F.col("label_j")).cast("double")).alias("r"))
    return labels.join(near, "id", "left").select("id", "label", F.coalesce("r", F.lit(0.0)).alias("rate"))


def mean_disagreement(rates: DataFrame) -> DataFrame:
    return rates.groupBy("label").agg(F.avg("rate").alias("avg_cross_label_rate"), F.count("*").alias("n_items"))


def run_summary(rates: DataFrame, found: DataFrame) -> DataFrame:
    base = rates.agg(F.count("*").alias("n_items"), F.countDistinct("label").alias("n_labels"), F.avg("rate").alias("mean_rate"), F.median("rate").alias("median_rate"))
    pairs = conflict_pairs(found).agg(F.coalesce(F.sum("conflict_count"), F.lit(0)).alias("n_conflicts"), F.count("*").alias("n_pairs"))
    return base.crossJoin(F.broadcast(pairs))  # one row each


def cluster_purity(clusters: DataFrame) -> DataFrame:
    """Share of items that have their cluster's most frequent label, over (cluster, label)."""
    counts = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("all")).agg((F.sum("top") / F.sum("all")).alias("purity"), F.count("*").alias("n_clusters"))


def first_examples(found: DataFrame, n: int = 25, same: list[str] | None = None) -> DataFrame:
    """The first n conflicts of each label pair in order of (i, rank); of rows that agree in the columns ``same``, if named, only the first counts."""
    if same:
        rest = [c for c in found.columns if c not in ("i", "rank", "j", *same)]
        found = found.groupBy(*same).agg(F.min(F.struct("i", "rank", "j", *rest)).alias("m")).select(*same, "m.*")
    w = W.partitionBy(F.least("label_i", "label_j"), F.greatest("label_i", "label_j")).orderBy("i", "rank", "j")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_examples(rows: DataFrame, by: list[str], order: str, n: int, tie: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc(order), tie)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def method_counts(rows: DataFrame, pair: list[str], methods: list[str]) -> DataFrame:
    """Counts of each pair by method, wide, with the row's total."""
    wide = rows.groupBy(*pair).pivot("method", methods).count().na.fill(0, methods)
    total = sum((F.col(m) for m in methods[1:]), F.col(methods[0]))
    return wide.withColumn("total", total)


def largest_rates(rows: DataFrame, n: int = 30) -> DataFrame:
    """Each label's largest rate over all methods, the n largest."""
    return rows.groupBy("label").agg(F.max("disagreement_rate").alias("max_rate")).orderBy(F.desc("max_rate"), "label").limit(n)
