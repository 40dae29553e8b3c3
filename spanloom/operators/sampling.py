"""Samples and splits; all are decided by id and seed, not by the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shuffled(id_col: str, seed: int) -> Column:
    """A place in a shuffled order: hex digits that any engine computes alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def capped_sample(units: DataFrame, per_label: int, order: str = "id") -> DataFrame:
    """id, label, round: labels by frequency take turns, each the next id not yet taken, up to ``per_label`` each.

    An id counts for every label it has. The greedy order is sequential, so one
    task decides; it needs no more than each label's first rows: an id is passed
    over only if another label took it, and all labels together take at most
    labels * per_label ids, so that many of each suffice.
    """
    flat = units.select("id", F.explode(F.array_distinct("labels")).alias("label"), F.col(order).alias("o"))
    freq = flat.groupBy("label").agg(F.count("*").alias("freq"))
    labels = freq.count()
    need = max(1, labels * per_label)
    w = W.partitionBy("label").orderBy("o", "id")
    rows = flat.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need).join(freq, "label")
    chosen = rows.select("id").distinct()
    own = flat.join(chosen, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("all"))
    rows = rows.join(own, "id")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "id"])
        queues = {x: iter(g[["id", "all"]].itertuples(index=False)) for x, g in pdf.groupby("label")}
        order_of = pdf.groupby("label")["freq"].first()
        turn = sorted(queues, key=lambda x: (-order_of[x], x))
        taken, count, out, number = set(), dict.fromkeys(queues, 0), [], 0
        while turn:
            still = []
            for label in turn:
                if count[label] >= per_label:
                    continue
                for unit in queues[label]:
                    if unit.id not in taken:
                        taken.add(unit.id)
                        for x in unit.all:
                            if x in count:
                                count[x] += 1
                        out.append((unit.id, label, number))
                        still.append(label)
                        break
            turn, number = still, number + 1
        return pd.DataFrame(out, columns=["id", "label", "round"])

    kind = dict(rows.dtypes)["id"]
    return rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(pick, f"id {kind}, label string, round int")


def shuffle_split(rows: DataFrame, shares: Sequence[tuple[str, float]], id_col: str = "id", seed: int = 42, buckets: int = 256) -> DataFrame:
    """``rows`` with ``split``: exact shares of a shuffled order, the last part taking the rest.

    Places come from counts of hash buckets and numbers within them, so that no
    task sees all rows.
    """
    key = shuffled(id_col, seed)
    placed = rows.withColumns({"__key": key, "__b": F.substring(key, 1, 2)})
    counts = placed.groupBy("__b").agg(F.count("*").alias("__c"))
    ahead = counts.select("__b", F.coalesce(F.sum("__c").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("__c").over(W.partitionBy(F.lit(0))).alias("__n"))
    placed = placed.join(F.broadcast(ahead), "__b")  # 256 rows
    place = F.col("__ahead") + F.row_number().over(W.partitionBy("__b").orderBy("__key", id_col)) - 1
    out, edge = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares[:-1]:
        edge += share
        cuts.append((name, edge))
    for name, edge in reversed(cuts):
        out = F.when(F.col("__place") < F.greatest(F.floor(F.col("__n") * edge + 1e-9), F.lit(1)), F.lit(name)).otherwise(out)
    return placed.withColumn("__place", place).withColumn("split", out).drop("__key", "__b", "__ahead", "__n", "__place")


def stratified_split(rows: DataFrame, label: str, share: float = 0.2, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: a share of each label's rows is ``test``; a plain split if a label has a single row.

    Within a label the rows whose draw is smallest are taken, found by quantile
    of hash buckets like a plain split's.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    least = counts.agg(F.min("__n")).first()[0]
    if least is None or least < 2:
        return shuffle_split(rows, [("test", share), ("train", 1 - share)], id_col, seed)
    key = shuffled(id_col, seed)
    placed = rows.withColumns({"__key": key, "__b": F.substring(key, 1, 2)})
    sums = placed.groupBy(label, "__b").agg(F.count("*").alias("__c"))
    by = W.partitionBy(label)
    sums = sums.select(label, "__b", F.coalesce(F.sum("__c").over(by.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("__c").over(by).alias("__n"))
    placed = placed.join(sums, [label, "__b"])
    place = F.col("__ahead") + F.row_number().over(W.partitionBy(label, "__b").orderBy("__key", id_col)) - 1
    return placed.withColumn("__place", place).withColumn("split", F.when(F.col("__place") < F.greatest(F.round(F.col("__n") * share), F.lit(1)), "test").otherwise("train")).drop("__key", "__b", "__ahead", "__n", "__place")


def random_split(rows: DataFrame, shares: Sequence[tuple[str, float]], id_col: str = "id", seed: int = 42) -> DataFrame:
    """``rows`` with ``split`` drawn for each id by itself: shares hold on average, and no shuffle is needed."""
    unit = F.conv(F.substring(shuffled(id_col, seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    out, edge, cuts = F.lit(shares[-1][0]), 0.0, []
    for name, share in shares[:-1]:
        edge += share
        cuts.append((name, edge))
    for name, edge in reversed(cuts):
        out = F.when(unit < edge, F.lit(name)).otherwise(out)
    return rows.withColumn("split", out)


def split_label_sums(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows and sums of 0/1 label columns of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), *[F.sum(x).alias(f"sum_{x}") for x in labels])


def topic_features(rows: DataFrame, text: str, topics: dict[str, list[str]]) -> DataFrame:
    from spanloom.functions.text import topic_count

    out = rows
    for name, words in topics.items():
        out = out.withColumn(f"topic_{name}_count", topic_count(F.col(text), words))
        out = out.withColumn(f"topic_{name}_has", (F.col(f"topic_{name}_count") > 0).cast("int"))
    return out
