"""Queries: nearest neighbours, conflicts between labels, comparison of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import blank_words
from spanloom.operators import neighbours as N
from spanloom.operators import represent as M
from spanloom.plans.registry import query, rounded, table

K, THRESHOLD = 5, 0.35  # the corpus takes 0.55; the tables' vectors are scattered, so that none would conflict

_KNN = f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM s QUALIFY rank <= {K}),
f AS (SELECT * FROM k WHERE sim >= {THRESHOLD} AND li <> lj)"""


def _labels(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label")).where("label IS NOT NULL")


def _pairs(spark, d):
    found = N.knn_cosine(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), K)
    return N.labelled(found, _labels(spark, d))


@query("knn_cosine", f"WITH {_KNN} SELECT i, j, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM k")
def knn_cosine(spark, d):
    found = N.knn_cosine(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), K)
    return rounded(found)


_PAIRS = "least(CAST(li AS VARCHAR), CAST(lj AS VARCHAR)) AS label_a, greatest(CAST(li AS VARCHAR), CAST(lj AS VARCHAR)) AS label_b"
_STATS = f"SELECT {_PAIRS}, count(*) AS conflict_count, round(avg(sim), 6) AS mean_similarity, round(median(sim), 6) AS median_similarity, round(max(sim), 6) AS max_similarity, round(min(sim), 6) AS min_similarity FROM f GROUP BY 1, 2"


@query("conflict_pairs", f"WITH {_KNN} {_STATS}")
def conflict_pairs(spark, d):
    return rounded(N.conflict_pairs(N.conflicts(_pairs(spark, d), THRESHOLD)))


@query("conflict_ratios", f"WITH {_KNN}, p AS ({_STATS}), c AS (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY 1) SELECT p.*, a.n AS n_a, b.n AS n_b, round(conflict_count / a.n, 6) AS ratio_a, round(conflict_count / b.n, 6) AS ratio_b FROM p JOIN c a ON a.label = label_a JOIN c b ON b.label = label_b")
def conflict_ratios(spark, d):
    counts = _labels(spark, d).groupBy("label").agg(F.count("*").alias("count"))
    return rounded(N.conflict_ratios(N.conflict_pairs(N.conflicts(_pairs(spark, d), THRESHOLD)), counts))


@query("pooled_disagreement", f"WITH {_KNN}, t AS (SELECT CAST(label AS VARCHAR) AS label, count(*) * {K} AS neighbor_total FROM embeddings GROUP BY 1), b AS (SELECT CAST(li AS VARCHAR) AS label, count(*) AS n FROM f GROUP BY 1) SELECT t.label, neighbor_total, coalesce(n, 0) AS neighbor_disagreement, round(coalesce(n, 0) / neighbor_total, 6) AS disagreement_rate FROM t LEFT JOIN b ON t.label = b.label")
def pooled_disagreement(spark, d):
    return rounded(N.pooled_disagreement(_pairs(spark, d), _labels(spark, d), THRESHOLD, K))


_RATES = f"{_KNN}, g AS (SELECT i, avg(CASE WHEN li <> lj THEN 1.0 ELSE 0.0 END) AS r FROM k WHERE sim >= {THRESHOLD} GROUP BY 1), r AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, coalesce(r, 0) AS rate FROM embeddings LEFT JOIN g ON vec_id = i)"


@query("mean_disagreement", f"WITH {_RATES} SELECT label, round(avg(rate), 6) AS avg_cross_label_rate, count(*) AS n_items FROM r GROUP BY 1")
def mean_disagreement(spark, d):
    return rounded(N.mean_disagreement(N.item_rates(_pairs(spark, d), _labels(spark, d), THRESHOLD)))


@query("ambiguity_summary", f"WITH {_RATES}, p AS ({_STATS}) SELECT count(*) AS n_items, count(DISTINCT label) AS n_labels, round(avg(rate), 6) AS mean_rate, round(median(rate), 6) AS median_rate, (SELECT CAST(coalesce(sum(conflict_count), 0) AS BIGINT) FROM p) AS n_conflicts, (SELECT count(*) FROM p) AS n_pairs FROM r")
def ambiguity_summary(spark, d):
    pairs = _pairs(spark, d)
    return rounded(N.run_summary(N.item_rates(pairs, _labels(spark, d), THRESHOLD), N.conflicts(pairs, THRESHOLD)))


@query("conflict_examples", f"WITH {_KNN} SELECT i, j, label_a, label_b, place FROM (SELECT i, j, {_PAIRS}, CAST(row_number() OVER (PARTITION BY least(CAST(li AS VARCHAR), CAST(lj AS VARCHAR)), greatest(CAST(li AS VARCHAR), CAST(lj AS VARCHAR)) ORDER BY i, rank, j) AS INTEGER) AS place FROM f) WHERE place <= 25")
def conflict_examples(spark, d):
    out = N.first_examples(N.conflicts(_pairs(spark, d), THRESHOLD), 25)
    return out.select("i", "j", F.least("label_i", "label_j").alias("label_a"), F.greatest("label_i", "label_j").alias("label_b"), "place")


@query("distinct_conflict_examples", f"WITH {_KNN}, x AS (SELECT i, j, rank, {_PAIRS}, row_number() OVER (PARTITION BY li, lj, j % 10 ORDER BY i, rank, j) AS k FROM f) SELECT i, j, label_a, label_b, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label_a, label_b ORDER BY i, rank, j) AS INTEGER) AS place FROM x WHERE k = 1) WHERE place <= 50")
def distinct_conflict_examples(spark, d):
    """Of conflicts with the same labels and the same neighbour's text (here a digit) the first, and 50 of each pair."""
    rows = N.conflicts(_pairs(spark, d), THRESHOLD).withColumn("text", F.col("j") % 10)
    out = N.first_examples(rows, 50, ["label_i", "label_j", "text"])
    return out.select("i", "j", F.least("label_i", "label_j").alias("label_a"), F.greatest("label_i", "label_j").alias("label_b"), "place")


@query("given_vectors", "SELECT item_id AS id, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(list_sum(CAST(embedding AS DOUBLE[])) AS DOUBLE), 6) AS total FROM benchmark JOIN embeddings ON vec_id = item_id")
def given_vectors(spark, d):
    """Vectors of texts that are there already are taken as they are."""
    given = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    out = M.vectors_or_tfidf(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), given)
    return rounded(out.select("id", F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("first_conflicts_overall", f"WITH {_KNN} SELECT i, j, CAST(rank AS INTEGER) AS rank FROM f ORDER BY i, rank LIMIT 200")
def first_conflicts_overall(spark, d):
    return N.conflicts(_pairs(spark, d), THRESHOLD).select("i", "j", "rank").orderBy("i", "rank").limit(200)


@query("top_examples_by_pair", f"WITH {_KNN}, x AS (SELECT i, j, {_PAIRS}, round(sim, 6) AS similarity FROM f) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label_a, label_b ORDER BY similarity DESC, i * 1000000 + j) AS INTEGER) AS place FROM x) WHERE place <= 3")
def top_examples_by_pair(spark, d):
    rows = rounded(N.conflicts(_pairs(spark, d), THRESHOLD).select("i", "j", F.least("label_i", "label_j").alias("label_a"), F.greatest("label_i", "label_j").alias("label_b"), "similarity"))
    return N.top_examples(rows.withColumn("t", F.col("i") * 1000000 + F.col("j")), ["label_a", "label_b"], "similarity", 3, "t").drop("t")


_LINES = "SELECT item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS words FROM benchmark WHERE text IS NOT NULL"


@query("similar_word_sets", f"WITH x AS ({_LINES}), p AS (SELECT a.id AS i, b.id AS j, len(list_intersect(a.words, b.words)) AS n, len(a.words) + len(b.words) AS m FROM x a JOIN x b ON a.id <> b.id) SELECT i, j, round(n / (m - n), 6) AS similarity FROM p WHERE n / (m - n) >= 0.05")
def similar_word_sets(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), blank_words(F.col("text")).alias("words"))
    return rounded(N.similar_sets(items, 0.05))


_TF = r"""
t AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark),
c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT id) AS n FROM t), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT id, c.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN f ON c.term = f.term, n), z AS (SELECT id, sqrt(sum(w * w)) AS z FROM w GROUP BY 1),
u AS (SELECT w.id, term, w / z AS weight FROM w JOIN z ON w.id = z.id)"""


def _tfidf(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return M.tfidf(M.word_terms(texts, 1))


@query("tfidf_weights", f"WITH {_TF} SELECT id, term, round(weight, 6) AS weight FROM u")
def tfidf_weights(spark, d):
    return rounded(_tfidf(spark, d))


@query("tfidf_neighbours", f"WITH {_TF}, p AS (SELECT a.id AS i, b.id AS j, sum(a.weight * b.weight) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2) SELECT i, j, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.3")
def tfidf_neighbours(spark, d):
    return rounded(N.sparse_cosine(_tfidf(spark, d), 0.3))


@query("char_ngram_counts", "SELECT item_id AS id, CAST(len(list_distinct(list_transform(range(1, length(text) + 1), lambda i: substring(' ' || lower(text) || ' ', CAST(i AS BIGINT), 3)))) AS BIGINT) AS n FROM benchmark WHERE length(text) > 0")
def char_ngram_counts(spark, d):
    texts = table(spark, d, "benchmark").where("length(text) > 0").select(F.col("item_id").alias("id"), "text")
    return M.char_terms(texts, 3, 3).groupBy("id").agg(F.count("*").alias("n"))


@query("cluster_purity", "WITH c AS (SELECT label % 3 AS cluster, label, count(*) AS n FROM embeddings GROUP BY 1, 2), m AS (SELECT cluster, max(n) AS top, sum(n) AS a FROM c GROUP BY 1) SELECT round(sum(top) / sum(a), 6) AS purity, count(*) AS n_clusters FROM m")
def cluster_purity(spark, d):
    return rounded(N.cluster_purity(table(spark, d, "embeddings").select((F.col("label") % 3).alias("cluster"), "label")))


@query("kmeans_purity")
def kmeans_purity(spark, d):
    e = table(spark, d, "embeddings")
    clusters = M.kmeans(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.select("label").distinct().count())
    return N.cluster_purity(clusters.join(e.select(F.col("vec_id").alias("id"), "label"), "id"))


@query("lsa_vectors")
def lsa_vectors(spark, d):
    return M.vectors_or_tfidf(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), None, 20)


_PROTO = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, label, unnest(e) AS x, unnest(range(len(e))) AS p FROM v),
m AS (SELECT label, p, avg(x) AS m FROM x GROUP BY 1, 2), q AS (SELECT label, list(m ORDER BY p) AS e FROM m GROUP BY 1)"""


@query("prototype_cosines", f"WITH {_PROTO} SELECT vec_id AS id, q.label, round(list_cosine_similarity(v.e, q.e), 6) AS cosine FROM v, q")
def prototype_cosines(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    dim = e.select(F.max(F.size("vector"))).first()[0] or 1
    return rounded(M.prototype_cosines(e.select("id", "vector"), M.prototypes(e, dim)))


@query("weighted_logistic_predictions")
def weighted_logistic_predictions(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    model, names = M.weighted_logistic(e)
    return M.predict(model, names, e).select("id", "true_label", "pred_label")


@query("method_counts", "SELECT o_orderstatus AS label_a, l_returnflag AS label_b, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS \"5-LOW\", count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '5-LOW')) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def method_counts(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return N.method_counts(rows.select(F.col("o_orderstatus").alias("label_a"), F.col("l_returnflag").alias("label_b"), F.col("o_orderpriority").alias("method")), ["label_a", "label_b"], ["1-URGENT", "5-LOW"])


@query("largest_rates", "SELECT CAST(s_nationkey AS VARCHAR) AS label, max(s_acctbal) AS max_rate FROM supplier GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def largest_rates(spark, d):
    return N.largest_rates(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("label"), F.col("s_acctbal").alias("disagreement_rate")))


@query("mlp_predictions")
def mlp_predictions(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    model, names = M.mlp(e, [16])
    return M.predict(model, names, e).select("id", "true_label", "pred_label")


@query("jaccard_neighbours", f"WITH x AS ({_LINES}), p AS (SELECT a.id AS i, b.id AS j, len(list_intersect(a.words, b.words)) AS n, len(a.words) + len(b.words) AS m FROM x a JOIN x b ON a.id <> b.id), s AS (SELECT i, j, n / (m - n) AS similarity FROM p WHERE n / (m - n) >= 0.05) SELECT i, j, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def jaccard_neighbours(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), blank_words(F.col("text")).alias("words"))
    return rounded(N.rank_neighbours(N.similar_sets(items, 0.05), K))
