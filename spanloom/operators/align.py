"""Fuzzy and positional alignment of spans with text units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.fuzzy import could_reach, ratio_udf
from spanloom.functions.segment import containing, relation, sentence_spans_udf
from spanloom.functions.text import tokens
from spanloom.operators.labels import small

LEAST_RATIO = 0.6


def best_matches(queries: DataFrame, candidates: DataFrame, key: str, *, query_first: bool = True, least: float = LEAST_RATIO) -> DataFrame:
    """query_id, cand_id, score: of each query's candidates under the same key the best, the first on ties.

    ``queries`` (key, query_id, query), ``candidates`` (key, cand_id, cand, pos).
    Queries whose best score is below ``least`` are left out. Lengths alone rule
    most pairs out before any is scored; candidates of one key are few (a
    message's annotations), and a best one is an aggregate, not a sort.
    """
    pairs = queries.join(candidates, key).where(could_reach(F.col("query"), F.col("cand"), least))
    score = ratio_udf("query", "cand") if query_first else ratio_udf("cand", "query")
    scored = pairs.select("query_id", "cand_id", "pos", score.alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"), "cand_id")).alias("b"))
    return best.select("query_id", "b.cand_id", "b.score")


def codebook_matches(labels: DataFrame, codebook: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """label, match, score: the closest codebook entry (entry, pos) of each distinct label.

    A codebook is a short list, broadcast if it is counted to be one; each label meets the entries that its length allows.
    """
    q = labels.select("label").where("label IS NOT NULL").distinct().select(F.lit(1).alias("k"), F.col("label").alias("query_id"), F.col("label").alias("query"))
    c = codebook.select(F.lit(1).alias("k"), F.col("entry").alias("cand_id"), F.col("entry").alias("cand"), "pos")
    return best_matches(q, small(c), "k", least=least).select(F.col("query_id").alias("label"), F.col("cand_id").alias("match"), "score")


def coverage_ratios(queries: DataFrame, matches: DataFrame, level: str) -> DataFrame:
    """Matched and total units of each level, and their ratio."""
    hit = matches.select("query_id").distinct().withColumn("hit", F.lit(1))
    rows = queries.join(hit, "query_id", "left")
    return rows.groupBy(level).agg(F.count("*").alias("total"), F.sum(F.coalesce("hit", F.lit(0))).alias("matched"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("coverage"))


def span_positions(spans: DataFrame) -> DataFrame:
    """Relation to the sentences, and tokens to the edges of the containing one, for rows (message, start, end).

    Other columns are kept.
    """
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    rows = spans.withColumns({"sentences": sentence_spans_udf("message"), "span": span})
    rows = rows.withColumns({"relation": relation(F.col("span"), F.col("sentences")), "home": containing(F.col("span"), F.col("sentences"))})
    left = F.substr("message", F.col("home.start") + 1, F.greatest(F.col("start").cast("int") - F.col("home.start"), F.lit(0)))
    right = F.substr("message", F.col("end").cast("int") + 1, F.greatest(F.col("home.end") - F.col("end").cast("int"), F.lit(0)))
    return rows.withColumns({"left_tokens": F.size(tokens(left)), "right_tokens": F.size(tokens(right))}).drop("sentences", "span", "home")


def offsets(row_fields: list[tuple[str, str]], columns: list[str]):
    """The first pair of offset fields that is there; null if it ends before it starts."""
    out = F.lit(None).cast("struct<start:int,end:int>")
    for a, b in reversed([p for p in row_fields if set(p) <= set(columns)]):
        start, end = F.col(a).try_cast("int"), F.col(b).try_cast("int")
        pair = F.when(end >= start, F.struct(start.alias("start"), end.alias("end")))
        out = F.when(start.isNotNull() & end.isNotNull(), pair).otherwise(out)
    return out
