"""Joins between messages, units, labels and logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.operators.labels import small


def attach_all(units: DataFrame, annotations: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Units with all values of the annotations that share their keys, in order."""
    found = units.select("unit_id", *on).join(annotations.select(*on, value), list(on))
    return found.groupBy("unit_id").agg(F.array_sort(F.collect_list(value)).alias("values"))


def last_by(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def attach_last(units: DataFrame, annotations: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Units with the last occurrence's value for their key, anywhere in the corpus; null on a miss."""
    return units.join(last_by(annotations, key, value, order), key, "left")


def side_by_side(parts: dict[str, DataFrame], on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """All parts by key, each value suffixed with its part's name; keys of any part are kept."""
    named = [d.select(*on, *[F.col(v).alias(f"{v}_{name}") for v in values]) for name, d in parts.items()]
    return reduce(lambda a, b: a.join(b, list(on), "full"), named)


def row_argmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``max_value`` and ``max_column`` over columns; nulls are skipped, the first column wins ties."""
    items = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("c"))) for i, c in enumerate(columns)]))
    best = F.array_max(items)
    return df.withColumns({"max_value": best["v"], "max_column": best["c"]})


def row_sum(df: DataFrame, columns: Sequence[str], name: str = "total") -> DataFrame:
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns]))


def same_label_pairs(clauses: DataFrame, message: str, key: str, label: str) -> DataFrame:
    """(source, target): clauses of one message with one label, both ways.

    Pairs are within a message only, whose clauses are few by nature.
    """
    a = clauses.select(message, label, F.col(key).alias("source"))
    b = clauses.select(message, label, F.col(key).alias("target"))
    return a.join(b, [message, label]).where("source <> target")


def neighbours(clauses: DataFrame, message: str, key: str) -> DataFrame:
    """Clauses with the ids before and after them in their message."""
    w = W.partitionBy(message).orderBy(key)
    return clauses.withColumns({"prev_id": F.lag(key).over(w), "next_id": F.lead(key).over(w)})


def chains(chunks: DataFrame, group: str | None = None) -> DataFrame:
    """Messages from chained chunks: each chain starts at the first unused chunk and follows ``next``.

    A step goes to the first unused chunk, in order of ``pos``, whose ``context``
    is the text in ``next``. Result: chain, step, pos, context. Chunks of
    different ``group`` never chain; without one all chunks are one group, as the
    order of use is sequential by definition.
    """
    key = F.col(group) if group else F.lit(0)
    rows = chunks.select(key.cast("string").alias("g"), F.col("pos").cast("long").alias("pos"), "context", "next")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        waiting: dict[str, list[int]] = {}
        items = list(pdf.itertuples(index=False))
        for i in reversed(range(len(items))):
            waiting.setdefault(items[i].context, []).append(i)
        used, out, chain = set(), [], 0
        for start in range(len(items)):
            at, step = start, 0
            while at is not None and at not in used:
                used.add(at)
                out.append((items[at].g, chain, step, items[at].pos, items[at].context))
                following = waiting.get(items[at].next, []) if items[at].next else []
                while following and following[-1] in used:
                    following.pop()
                at, step = (following[-1] if following else None), step + 1
            chain += step > 0
        return pd.DataFrame(out, columns=["g", "chain", "step", "pos", "context"])

    return rows.groupBy("g").applyInPandas(follow, "g string, chain long, step long, pos long, context string")


def repeated_across(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Rows whose key occurs in more than one part."""
    several = rows.groupBy(key).agg(F.countDistinct(part).alias("n")).where("n > 1").select(key)
    return rows.join(several, key, "left_semi")


def compare_models(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("Sentence", "Clause")) -> DataFrame:
    """text and outcome for texts in both logs (text, correct, ord); of repeated texts the last counts."""
    a = last_by(first, "text", "correct", "ord").select("text", F.col("correct").alias("a"))
    b = last_by(second, "text", "correct", "ord").select("text", F.col("correct").alias("b"))
    outcome = F.when(F.col("a") & F.col("b"), "Both Correct").when(F.col("a"), f"Only {names[0]} Correct").when(F.col("b"), f"Only {names[1]} Correct").otherwise("Both Wrong")
    return a.join(b, "text").select("text", outcome.alias("outcome"))


def to_do(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def attach_or_zero(rows: DataFrame, features: DataFrame, key: str, dim: int) -> DataFrame:
    """Feature vectors by key, zeros on a miss."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return rows.join(features.select(key, "features"), key, "left").withColumn("features", F.coalesce("features", zero))


def graph_labels(graphs: DataFrame, units: DataFrame, pick: str = "first_subcode") -> DataFrame:
    """Graph ids with a label of the unit of the same id; units without one are skipped.

    ``first_subcode``: the first label of level subcode; ``last``: the last of any level.
    """
    label = F.get(F.filter("labels", lambda x: x["level"] == "subcode"), 0)["label"] if pick == "first_subcode" else F.element_at("labels", -1)["label"]
    return graphs.join(units.select(F.col("id").alias("graph_id"), "text", label.alias("label")), "graph_id").where("label IS NOT NULL")


def mapped_or_counted(rows: DataFrame, mapping: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose lower-cased label is mapped, and the count of those that aren't."""
    dim = mapping.select(F.lower("raw").alias("__raw"), F.col("matched_codebook_label").alias("mapped")).dropDuplicates(["__raw"])
    lost = rows.join(small(dim), F.lower(label) == F.col("__raw"), "left_anti").agg(F.count("*").alias("dropped"))
    return rows.join(small(dim), F.lower(label) == F.col("__raw")).drop("__raw"), lost


def annotated_units(messages: DataFrame) -> DataFrame:
    """level, id, content, span: sentences and subsentences of segmented messages that have a span, and messages in which any has one."""
    filled = lambda x: F.coalesce(x["most_close_annotation_span"], F.lit("")) != ""
    any_in = F.exists("sentences", lambda s: filled(s) | F.coalesce(F.exists(s["subsentences"], filled), F.lit(False)))
    whole = messages.where(any_in).select(F.lit("message").alias("level"), F.col("message_id").cast("string").alias("id"), F.col("message").alias("content"), F.lit(None).cast("string").alias("span"))
    sentences = messages.select(F.explode("sentences").alias("s"))
    subs = sentences.select(F.explode("s.subsentences").alias("u"))
    out = whole
    for rows, name, level in ((sentences.select("s.*"), "sentence", "sentence"), (subs.select("u.*"), "subsentence", "subsentence")):
        kept = rows.where("coalesce(most_close_annotation_span, '') <> ''")
        out = out.unionByName(kept.select(F.lit(level).alias("level"), F.col(f"{name}_id").alias("id"), F.col(name).alias("content"), F.col("most_close_annotation_span").alias("span")))
    return out
