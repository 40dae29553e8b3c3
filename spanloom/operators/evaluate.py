"""Evaluation of predictions and comparison of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Names that prediction records use for the same field, in order of preference.
FIELD_NAMES = {
    "true_label": ("true_label", "gold_label", "label"),
    "pred_label": ("pred_label", "predicted_label", "prediction"),
    "text": ("text", "original_text"),
    "id": ("id", "graph_id", "center_id"),
}


def normalise_predictions(rows: DataFrame) -> DataFrame:
    """id, text, true_label, pred_label and whether they agree, whatever the record's names; fields that are nowhere are null."""
    out = []
    for name, options in FIELD_NAMES.items():
        there = [F.col(c).cast("string") for c in options if c in rows.columns]
        out.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name))
    found = rows.select(*out)
    return recompute_correct(found)


def recompute_correct(rows: DataFrame) -> DataFrame:
    return rows.withColumn("correct", F.coalesce(F.col("true_label") == F.col("pred_label"), F.lit(False)))


def class_report(rows: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support over all true and predicted labels; 0 where a share has no base."""
    sides = rows.select(F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("true_label") == F.col("pred_label")).cast("int").alias("hit")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")),
    )).alias("x")).select("x.*").where("label IS NOT NULL")
    sums = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum(F.coalesce("hit", F.lit(0))).alias("tp"))
    share = lambda base: F.when(F.col(base) > 0, F.col("tp") / F.col(base)).otherwise(F.lit(0.0))
    out = sums.withColumns({"precision": share("predicted"), "recall": share("support")})
    both = F.col("precision") + F.col("recall")
    return out.select("label", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)).alias("f1"), "support")


def scores(rows: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """accuracy, macro_f1 and micro_f1; macro averages over ``labels``, absent ones as 0, or over those found."""
    report = class_report(rows)
    n = F.lit(len(labels)) if labels is not None else F.count("*")
    macro = report.agg((F.sum("f1") / n).alias("macro_f1"))
    agree = F.coalesce(F.col("true_label") == F.col("pred_label"), F.lit(False)).cast("double")
    one = rows.agg(F.avg(agree).alias("accuracy"), F.count("*").alias("n"))
    return one.crossJoin(F.broadcast(macro)).select("n", "accuracy", "macro_f1", F.col("accuracy").alias("micro_f1"))  # one label each: micro F1 is accuracy


def multi_label_scores(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """exact_match, macro_f1, micro_f1 over arrays of true and predicted labels."""
    sums = []
    for i, x in enumerate(labels):
        t, p = F.array_contains("true_labels", x), F.array_contains("pred_labels", x)
        sums += [F.sum((t & p).cast("long")).alias(f"tp{i}"), F.sum((t != p).cast("long")).alias(f"off{i}")]
    exact = F.avg((F.array_sort("true_labels") == F.array_sort("pred_labels")).cast("double")).alias("exact_match")
    one = rows.agg(exact, F.count("*").alias("n"), *sums)
    f1 = lambda tp, off: F.when(2 * tp + off > 0, 2 * tp / (2 * tp + off)).otherwise(F.lit(0.0))
    tp, off = sum((F.col(f"tp{i}") for i in range(1, len(labels))), F.col("tp0")), sum((F.col(f"off{i}") for i in range(1, len(labels))), F.col("off0"))
    macro = sum((f1(F.col(f"tp{i}"), F.col(f"off{i}")) for i in range(len(labels))), F.lit(0.0)) / len(labels)
    return one.select("n", "exact_match", macro.alias("macro_f1"), f1(tp, off).alias("micro_f1"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("true_label", "pred_label").agg(F.count("*").alias("count"))


def top_probabilities(rows: DataFrame, n: int = 3) -> DataFrame:
    """id, label, probability, rank of each row's n largest probabilities; ``probabilities`` is a map."""
    flat = rows.select("id", F.explode("probabilities").alias("label", "probability"))
    return flat.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("probability"), "label"))).where(F.col("rank") <= n)


def best_epochs(log: DataFrame) -> DataFrame:
    """Each model's first epoch of highest F1, and its last epoch."""
    best = F.max(F.struct("f1", (-F.col("epoch")).alias("e"), "accuracy"))
    last = F.max(F.struct("epoch", "f1"))
    out = log.groupBy("model").agg(best.alias("b"), last.alias("l"))
    return out.select("model", (-F.col("b.e")).alias("best_epoch"), F.col("b.f1").alias("best_f1"), F.col("b.accuracy").alias("best_accuracy"), F.col("l.epoch").alias("last_epoch"), F.col("l.f1").alias("last_f1"))


def error_table(errors: DataFrame, models: Sequence[str]) -> DataFrame:
    """Errors of each true label by model, 0 where there are none, with the row's total."""
    wide = errors.groupBy("true_label").pivot("model", list(models)).count().na.fill(0, list(models))
    return wide.withColumn("total", sum((F.col(m) for m in models[1:]), F.col(models[0])))


def label_space(*parts: DataFrame) -> DataFrame:
    """Distinct labels of the first columns of all parts."""
    out = parts[0].select(F.col(parts[0].columns[0]).alias("label"))
    for p in parts[1:]:
        out = out.union(p.select(F.col(p.columns[0]).alias("label")))
    return out.where("label IS NOT NULL").distinct()
