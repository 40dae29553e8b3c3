"""Phrase and label association, and sentence scores from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.numbers import softmax
from spanloom.functions.text import blank_words, char_ngrams, jaccard, keyword_hit, normalize_phrase
from spanloom.operators.labels import small

#: N-gram length, gates of fuzzy matches, matches kept, weight of the prior, boost of keyword hits.
NGRAM, LEAST_JACCARD, LEAST_TOKENS, MOST_MATCHES, PRIOR_SCALE, BOOST = 3, 0.85, 0.85, 5, 0.5, 1.5


def type_counts(phrases: DataFrame, *by: str) -> DataFrame:
    """Counts of phrase types by the given columns, every cell of the grid included."""
    if not by:
        return phrases.groupBy("type").agg(F.count("*").alias("count"))
    axes = [phrases.select(c).where(F.col(c).isNotNull()).distinct() for c in (*by, "type")]
    grid = reduce(lambda a, b: a.crossJoin(small(b)), axes)  # few labels, fields and types
    counts = phrases.groupBy(*by, "type").agg(F.count("*").alias("c"))
    return grid.join(counts, [*by, "type"], "left").select(*by, "type", F.coalesce("c", F.lit(0)).alias("count"))


def document_frequencies(phrases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text, type, occurrences, doc_freq), (label, doc_freq) and (text, type, label, cofreq): distinct records of each."""
    flat = phrases.select("rec_id", "text", "type", "label")
    pool = flat.dropDuplicates(["rec_id", "text", "type"]).groupBy("text", "type").agg(F.count("*").alias("doc_freq"))
    seen = phrases.select("rec_id", "text", "type", "occ").distinct() if "occ" in phrases.columns else phrases.select("rec_id", "text", "type")
    occurrences = seen.groupBy("text", "type").agg(F.count("*").alias("occurrences"))
    pool = pool.join(occurrences, ["text", "type"])
    labels = flat.select("rec_id", "label").distinct().groupBy("label").agg(F.count("*").alias("label_freq"))
    both = flat.distinct().groupBy("text", "type", "label").agg(F.count("*").alias("doc_cofreq"))
    return pool, labels, both


def association(phrases: DataFrame) -> DataFrame:
    """text, type, label, doc_cofreq, pmi: log2 of how much more often both meet than by chance.

    Pairs that never meet have no row, and so no PMI.
    """
    pool, labels, both = document_frequencies(phrases)
    n = phrases.select("rec_id").distinct().agg(F.count("*").alias("n"))
    rows = both.join(pool, ["text", "type"]).join(labels, "label").crossJoin(F.broadcast(n))  # one row
    pmi = F.log2(F.col("doc_cofreq") * F.col("n") / (F.col("doc_freq") * F.col("label_freq")))
    return rows.select("text", "type", "label", "doc_cofreq", pmi.alias("pmi"))


def phrase_pool(phrases: DataFrame, edges: DataFrame) -> DataFrame:
    """Each phrase with its best label by PMI (the first by name on ties), purity and entropy over its labels."""
    pool, _, _ = document_frequencies(phrases)
    c = F.col("doc_cofreq")
    total = edges.groupBy("text", "type").agg(F.sum(c).alias("s"))
    rows = edges.join(total, ["text", "type"])
    stats = rows.groupBy("text", "type").agg(
        F.min(F.struct((-F.col("pmi")).alias("m"), "label")).alias("top"), (F.max(c) / F.max("s")).alias("label_purity"), (-F.sum(c / F.col("s") * F.log2(c / F.col("s")))).alias("label_entropy"),
    )
    out = pool.join(stats, ["text", "type"], "left")
    return out.select(
        "text", "type", "occurrences", "doc_freq", F.col("top.label").alias("top_label"), (-F.col("top.m")).alias("top_pmi"),
        F.coalesce("label_purity", F.lit(0.0)).alias("label_purity"), F.coalesce("label_entropy", F.lit(0.0)).alias("label_entropy"),
    )


def overview(phrases: DataFrame) -> DataFrame:
    """Records, sentences, clauses, phrases, and phrases per each (rec_id, sent_no, clause_no)."""
    one = phrases.agg(F.countDistinct("rec_id").alias("records"), F.countDistinct("rec_id", "sent_no").alias("sentences"), F.countDistinct("rec_id", "sent_no", "clause_no").alias("clauses"), F.count("*").alias("phrases"))
    return one.select("*", *[(F.col("phrases") / F.col(f"{x}s")).alias(f"phrases_per_{x}") for x in ("record", "sentence", "clause")])


def build_index(pool: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, scores): phrases and their label scores merged by normalised text and type."""
    norm = normalize_phrase(F.col("text"))
    keys = pool.withColumn("norm", norm).groupBy("norm", "type").agg(
        F.max("doc_freq").alias("doc_freq"), F.sum("occurrences").alias("occurrences"), F.slice(F.array_sort(F.collect_set("text")), 1, 5).alias("examples"),
        F.max("label_purity").alias("label_purity"), F.max("label_entropy").alias("label_entropy"),
    )
    scores = edges.withColumn("norm", norm).groupBy("norm", "type", "label").agg(F.sum("doc_cofreq").alias("cofreq"), F.max("pmi").alias("pmi"))
    return keys, scores


def label_prior(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.sum("doc_cofreq").alias("prior"))


def candidates(phrases: DataFrame, keys: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """phrase_id, norm, type, similarity: an exact key first, then keys of the type whose trigrams and words overlap enough.

    Both gates are overlaps of sets, so phrases meet keys on their rarest words,
    one of which any pair that passes the second gate shares; lengths and that
    gate prune before trigrams are compared.
    """
    ask = phrases.select("phrase_id", "type", normalize_phrase(F.col("text")).alias("q"))
    have = keys.select(F.col("norm"), "type")
    exact = ask.join(have, (F.col("q") == F.col("norm")) & (ask["type"] == have["type"])).select("phrase_id", "norm", ask["type"], F.lit(1.0).alias("similarity"), F.lit(1).alias("exact"))
    asked = ask.select("q", "type").distinct().withColumn("words", blank_words(F.col("q")))
    index = have.withColumn("words", blank_words(F.col("norm")))
    df = index.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def rare(rows: DataFrame, name: str) -> DataFrame:
        flat = rows.select(name, "type", F.size("words").alias(f"n_{name}"), F.explode("words").alias("w")).join(df, "w", "left")
        flat = flat.withColumn("place", F.row_number().over(W.partitionBy(name, "type").orderBy(F.coalesce("df", F.lit(0)), "w")))
        return flat.where(F.col("place") <= F.col(f"n_{name}") - F.ceil(F.col(f"n_{name}") * F.lit(LEAST_TOKENS)) + 1).select(name, "type", f"n_{name}", "w")

    met = rare(asked, "q").join(rare(index, "norm"), ["type", "w"]).where("q <> norm")
    met = met.where(F.least("n_q", "n_norm") >= F.lit(LEAST_TOKENS) * F.greatest("n_q", "n_norm")).select("q", "norm", "type").distinct()
    near = met.where(jaccard(blank_words(F.col("q")), blank_words(F.col("norm"))) >= LEAST_TOKENS)
    near = near.withColumn("similarity", jaccard(char_ngrams(F.col("q"), NGRAM), char_ngrams(F.col("norm"), NGRAM))).where(F.col("similarity") >= LEAST_JACCARD)
    near = ask.join(near, ["q", "type"]).select("phrase_id", "norm", "type", "similarity", F.lit(0).alias("exact"))
    w = W.partitionBy("phrase_id").orderBy(F.desc("similarity"), F.desc("exact"), "norm")
    return exact.unionByName(near).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place", "exact")


def sentence_scores(phrases: DataFrame, found: DataFrame, scores: DataFrame, prior: DataFrame, groups: dict[str, list[str]] | None = None, temperature: float = 1.0) -> DataFrame:
    """sentence_id, label, score, probability: what its phrases' matches say about a sentence, plus a prior for every label.

    A PMI below 0 counts as 0. ``groups``: patterns by label whose hit in a
    phrase raises that label's score by half.
    """
    rows = phrases.select("phrase_id", "sentence_id", "text").join(found, "phrase_id").join(scores, ["norm", "type"])
    boost = F.lit(1.0)
    for label, patterns in (groups or {}).items():
        boost = F.when((F.col("label") == label) & keyword_hit(F.col("text"), patterns), F.lit(BOOST)).otherwise(boost)
    weight = F.greatest(F.col("pmi"), F.lit(0.0)) * F.log1p(F.col("cofreq").cast("double")) * boost * F.col("similarity")
    hits = rows.groupBy("sentence_id", "label").agg(F.sum(weight).alias("hit"))
    base = prior.where("prior > 0").select("label", (F.lit(PRIOR_SCALE) * F.log1p(F.col("prior").cast("double"))).alias("base"))
    sentences = phrases.select("sentence_id").distinct()
    every = sentences.crossJoin(small(base))  # a codebook's labels
    out = every.join(hits, ["sentence_id", "label"], "left").select("sentence_id", "label", (F.coalesce("hit", F.lit(0.0)) + F.col("base")).alias("score"))
    return out.withColumn("probability", softmax(F.col("score"), W.partitionBy("sentence_id"), temperature))
