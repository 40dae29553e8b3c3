"""Queries: segmentation, fuzzy alignment and span positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import fuzzy, segment
from spanloom.operators import align as A
from spanloom.operators import hierarchy as H
from spanloom.operators import spans as S
from spanloom.plans.registry import query, rounded, table
from spanloom import schemas


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query("sentence_spans")
def sentence_spans(spark, d):
    rows = _turns(spark, d).withColumn("s", segment.sentence_spans_udf("text"))
    return rows.select("conv_id", "turn", F.posexplode("s").alias("pos", "s")).select("conv_id", "turn", "pos", "s.start", "s.end")


@query("segmented_messages")
def segmented_messages(spark, d):
    """One row per clause: the segmented form, flat."""
    rows = _turns(spark, d).withColumn("s", segment.segment_udf()("text")).select("conv_id", "turn", F.posexplode("s").alias("i", "s"))
    base = F.concat_ws("_", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("i").cast("string"))
    rows = rows.select(base.alias("sentence_id"), F.col("s.sentence").alias("sentence"), F.posexplode("s.subsentences").alias("j", "subsentence"))
    return rows.select("sentence_id", F.concat_ws("_", "sentence_id", F.col("j").cast("string")).alias("subsentence_id"), "subsentence")


@query("message_tree")
def message_tree(spark, d):
    flat = segmented_messages(spark, d)
    subs = flat.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("subsentence_id", "subsentence", F.lit("").alias("most_close_annotation_span")))).alias("subsentences"))
    message = F.substring_index("sentence_id", "_", 1)
    sentences = subs.groupBy(message.alias("message_id")).agg(F.array_sort(F.collect_list(F.struct("sentence_id", F.lit("").alias("sentence"), F.lit("").alias("most_close_annotation_span"), "subsentences"))).alias("sentences"))
    return H.message_tree(sentences)


def _located(spark, d):
    """Passages of the benchmark where they stand in documents, exactly or by normalised forms.

    A passage's normalised words but the first and the last, which may be parts of
    longer words, are whole words of any text that holds it: the first eight of
    those are a key. Passages of one or two words meet all documents whose
    normalised form holds theirs.
    """
    spans = table(spark, d, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("span"), fuzzy.match_form_udf("text").alias("wanted"))
    spans = spans.withColumn("n", F.greatest(F.least(F.lit(8), F.size(F.split("wanted", " ")) - 2), F.lit(0)))
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.col("text").alias("message"))
    lengths = sorted(r["n"] for r in spans.select("n").distinct().collect())  # 0 to 8
    met = None
    if 0 in lengths:
        forms = docs.select("doc_id", fuzzy.match_form_udf("message").alias("form"))
        met = forms.join(spans.where("n = 0"), F.col("form").contains(F.col("wanted"))).select("doc_id", "item_id", "span")
    for n in (n for n in lengths if n):
        keys = spans.where(F.col("n") == n).select("item_id", "span", F.get(fuzzy.inner_runs_udf("wanted", F.lit(n), F.lit(True)), 0).alias("k"))
        grams = docs.select("doc_id", F.explode(fuzzy.inner_runs_udf("message", F.lit(n), F.lit(False))).alias("k"))
        found = grams.join(keys, "k").select("doc_id", "item_id", "span")
        met = found if met is None else met.unionByName(found)
    met = spans.join(docs, F.lit(False)).select("doc_id", "item_id", "span") if met is None else met.distinct()
    return met.join(docs, "doc_id").withColumn("at", fuzzy.locate_udf("span", "message")).where("at.start IS NOT NULL").select("doc_id", "item_id", "message", "at.start", "at.end")


@query("span_positions")
def span_positions(spark, d):
    return A.span_positions(_located(spark, d)).drop("message")


@query("span_relation_shares")
def span_relation_shares(spark, d):
    return S.relation_shares(A.span_positions(_located(spark, d)), "relation")


@query("span_boundary_stats")
def span_boundary_stats(spark, d):
    return S.boundary_stats(A.span_positions(_located(spark, d)), "left_tokens", "right_tokens")


def _units(spark, d):
    """Sentences of turns against the texts of their own conversation's turns, as annotations would be."""
    sents = sentence_spans(spark, d).join(_turns(spark, d), ["conv_id", "turn"]).withColumn("sentence", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    q = sents.select(F.col("conv_id").alias("k"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("conv_id", "turn", "pos")]).alias("query_id"), F.col("sentence").alias("query"), F.when(F.col("pos") == 0, "first").otherwise("later").alias("level"))
    c = _turns(spark, d).select(F.col("conv_id").alias("k"), F.col("turn").alias("cand_id"), F.col("text").alias("cand"), F.col("turn").alias("pos"))
    return q, c


@query("best_fuzzy_matches")
def best_fuzzy_matches(spark, d):
    q, c = _units(spark, d)
    return A.best_matches(q.drop("level"), c, "k")


@query("fuzzy_coverage")
def fuzzy_coverage(spark, d):
    q, c = _units(spark, d)
    return A.coverage_ratios(q, A.best_matches(q.drop("level"), c, "k", query_first=False), "level")


@query("codebook_fuzzy_matches")
def codebook_fuzzy_matches(spark, d):
    codebook = table(spark, d, "part").select("p_type").distinct().select(F.lower("p_type").alias("entry"), F.lit(0).alias("pos"))
    return A.codebook_matches(table(spark, d, "part").select(F.col("p_name").alias("label")), codebook)


@query("offsets_read", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= l_linenumber THEN l_linenumber END AS start, CASE WHEN l_quantity >= l_linenumber THEN CAST(l_quantity AS INTEGER) END AS \"end\" FROM lineitem")
def offsets_read(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("start_char"), F.col("l_quantity").cast("int").cast("string").alias("end_char"))
    at = A.offsets([("start", "end"), ("start_char", "end_char")], rows.columns)
    return rows.select("l_orderkey", "l_linenumber", at.alias("at")).select("l_orderkey", "l_linenumber", "at.start", "at.end")


@query("interval_overlaps", "WITH x AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INTEGER) % 3 AS b FROM lineitem), y AS (SELECT l_orderkey, a < lag(b) OVER (PARTITION BY l_orderkey ORDER BY a, b) AS o FROM x) SELECT l_orderkey, coalesce(bool_or(o), false) AS overlaps FROM y GROUP BY 1")
def interval_overlaps(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("end")).alias("s"))
    return rows.groupBy("l_orderkey").agg(F.collect_list("s").alias("s")).select("l_orderkey", segment.overlaps(F.col("s")).alias("overlaps"))


@query("greedy_intervals")
def greedy_intervals(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in segment.CHUNK_PRIORITY]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1 + F.col("l_quantity").cast("int") % 3).alias("end"), kind.alias("type")).alias("s"))
    picked = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s")).select("l_orderkey", F.explode(segment.pick_apart_udf("s")).alias("s"))
    return picked.select("l_orderkey", "s.*")


@query("repaired_chunks")
def repaired_chunks(spark, d):
    """Chunks of turns with every third sentence's span shifted, repaired, and what is still wrong with them (nothing)."""
    rows = _turns(spark, d).withColumn("s", segment.sentence_spans_udf("text"))
    made = F.transform("s", lambda x, i: F.struct(
        F.substr("text", x["start"] + 1, x["end"] - x["start"]).alias("text"), (x["start"] + F.when(i % 3 == 2, 1).otherwise(0)).cast("int").alias("start"), x["end"].cast("int").alias("end"),
        F.array().cast(f"array<{schemas.CLAUSE}>").alias("clauses")))
    rows = rows.select("conv_id", "turn", "text", F.struct(F.col("text").alias("input"), made.alias("sentences")).alias("r"))
    rows = rows.withColumn("before", F.size(segment.faults_udf("text", "r"))).withColumn("r", segment.repair_udf(schemas.FIELD_RESULT)("r"))
    return rows.select("conv_id", "turn", "before", F.size(segment.faults_udf("text", "r")).alias("after"), F.size("r.sentences").alias("n_sentences"))
