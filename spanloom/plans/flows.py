"""Whole analyses from raw messages to results, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import segment
from spanloom.functions.text import first_filled
from spanloom.operators import align, distributions, labels, neighbours, phrases, relations, represent


def process_messages(chunks: DataFrame, group: str | None = None) -> DataFrame:
    """message, message_id, annotations from chained chunks: texts joined in order, annotations numbered within their message."""
    steps = relations.chains(chunks, group)
    key = F.col(group).cast("string") if group else F.lit("0")
    rows = steps.join(chunks.select(key.alias("g"), F.col("pos").cast("long").alias("pos"), "annotations"), ["g", "pos"])
    parts = rows.groupBy("g", "chain").agg(F.array_sort(F.collect_list(F.struct("step", "context", "annotations"))).alias("p"))
    parts = parts.select("g", "chain", F.array_join("p.context", " ").alias("message"), F.flatten(F.transform("p", lambda x: F.coalesce(x["annotations"], F.array().cast("array<struct<text:string,codes:array<string>,start:bigint,end:bigint>>")))).alias("a"))
    number = F.xxhash64("g", "chain")
    one = lambda a, i: F.struct(F.concat_ws("_", F.col("message_id").cast("string"), i.cast("string")).alias("text_id"), a["text"].alias("text"), a["codes"].alias("code"))
    return parts.withColumn("message_id", number).select("message", "message_id", F.transform("a", one).alias("annotations"))


def labelled_units(messages: DataFrame, mapping: DataFrame, tagger: segment.Tagger = segment.plain_tagger, least: float = align.LEAST_RATIO) -> DataFrame:
    """id, level, text, span, code, subcode of each sentence and clause, with the closest annotation of its message, if close enough, and its mapped labels."""
    base = messages.select("message_id", "annotations", F.posexplode(segment.segment_udf(tagger)("message")).alias("i", "s"))
    sid = F.concat_ws("_", F.col("message_id").cast("string"), F.col("i").cast("string"))
    sentences = base.select("message_id", sid.alias("id"), F.lit("sentence").alias("level"), F.col("s.sentence").alias("text"))
    clauses = base.select("message_id", sid.alias("sid"), F.posexplode("s.subsentences").alias("j", "text")).select("message_id", F.concat_ws("_", "sid", F.col("j").cast("string")).alias("id"), F.lit("clause").alias("level"), "text")
    units = sentences.unionByName(clauses)
    notes = messages.select("message_id", F.posexplode("annotations").alias("pos", "a")).select("message_id", "pos", "a.text", "a.code")
    best = align.best_matches(
        units.select(F.col("message_id").alias("k"), F.col("id").alias("query_id"), F.col("text").alias("query")),
        notes.select(F.col("message_id").alias("k"), F.col("pos").alias("cand_id"), F.col("text").alias("cand"), "pos"), "k", least=least,
    )
    spans = units.join(best.select(F.col("query_id").alias("id"), F.col("cand_id").alias("pos")), "id", "left").join(notes.select("message_id", "pos", F.col("text").alias("span"), "code"), ["message_id", "pos"], "left")
    found = labels.mapped_labels(spans.where("code IS NOT NULL").select("id", F.col("code").alias("codes")), mapping)
    return spans.select("id", "level", "text", "span").join(found, "id", "left")


def label_report(units: DataFrame) -> DataFrame:
    """Imbalance of codes, subcodes and their combinations."""
    return distributions.compare_types({
        "code": distributions.label_counts(units, "code"),
        "subcode": distributions.label_counts(units, "subcode"),
        "combined": distributions.label_counts(units, labels.counting_label(F.col("code"), F.col("subcode"))),
    })


def ambiguity(items: DataFrame, k: int = 5, threshold: float = 0.55, embeddings: DataFrame | None = None, dims: int = 200) -> dict[str, DataFrame]:
    """Conflicting label pairs, disagreement by label and a summary, over (id, label, span, text)."""
    texts = items.select("id", first_filled(F.col("span"), F.col("text")).alias("text")).where("text IS NOT NULL")
    tags = items.select("id", "label").where("label IS NOT NULL")
    found = neighbours.labelled(neighbours.knn_cosine(represent.vectors_or_tfidf(texts, embeddings, dims), k), tags)
    rates, bad = neighbours.item_rates(found, tags, threshold), neighbours.conflicts(found, threshold)
    return {"pairs": neighbours.conflict_pairs(bad), "labels": neighbours.mean_disagreement(rates), "summary": neighbours.run_summary(rates, bad), "examples": neighbours.first_examples(bad)}


def score_sentences(known: DataFrame, asked: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Label probabilities of asked sentences (phrases by sentence) from labelled phrases."""
    edges = phrases.association(known)
    keys, scores = phrases.build_index(phrases.phrase_pool(known, edges), edges)
    return phrases.sentence_scores(asked, phrases.candidates(asked, keys), scores, phrases.label_prior(edges), groups)
