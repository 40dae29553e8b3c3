"""Queries: samples, splits and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import evaluate as E
from spanloom.operators import sampling as P
from spanloom.plans.registry import query, rounded, table

_ORDER = "md5('42:' || CAST(doc_id AS VARCHAR))"


@query("shuffle_split", f"""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}, doc_id) - 1 AS place, count(*) OVER () AS n FROM labels)
SELECT doc_id, CASE WHEN place < greatest(floor(n * 0.2 + 1e-9), 1) THEN 'test' WHEN place < greatest(floor(n * (0.2 + 0.1) + 1e-9), 1) THEN 'dev' ELSE 'train' END AS split FROM o""")  # fmt: skip
def shuffle_split(spark, d):
    return P.shuffle_split(table(spark, d, "labels").select("doc_id"), [("test", 0.2), ("dev", 0.1), ("train", 0.7)], "doc_id")


@query("stratified_split", f"""
WITH o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_ORDER}, doc_id) - 1 AS place, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN place < greatest(round(n * 0.2), 1) THEN 'test' ELSE 'train' END AS split FROM o""")  # fmt: skip
def stratified_split(spark, d):
    return P.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "quality", 0.2, "doc_id")


@query("random_split", f"WITH u AS (SELECT doc_id, CAST('0x' || substr({_ORDER}, 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' ELSE 'test' END AS split FROM u")
def random_split(spark, d):
    return P.random_split(table(spark, d, "documents").select("doc_id"), [("train", 0.8), ("test", 0.2)], "doc_id")


@query("split_label_sums", f"WITH u AS (SELECT quality, toxic, CAST('0x' || substr({_ORDER}, 1, 8) AS BIGINT) / 4294967296.0 AS u FROM labels) SELECT CASE WHEN u < 0.8 THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, CAST(sum(quality) AS BIGINT) AS sum_quality, CAST(sum(toxic) AS BIGINT) AS sum_toxic FROM u GROUP BY 1")
def split_label_sums(spark, d):
    return P.split_label_sums(P.random_split(table(spark, d, "labels"), [("train", 0.8), ("test", 0.2)], "doc_id"), ["quality", "toxic"])


@query("capped_sample")
def capped_sample(spark, d):
    return P.capped_sample(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("labels")), 20)


# predictions: what a class rule over line items says against their flags

_PRED = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS true_label, CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 30 THEN 'N' WHEN l_quantity < 45 THEN 'R' ELSE 'X' END AS pred_label FROM lineitem"


def _predictions(spark, d):
    rows = table(spark, d, "lineitem")
    pred = F.when(F.col("l_quantity") < 10, "A").when(F.col("l_quantity") < 30, "N").when(F.col("l_quantity") < 45, "R").otherwise("X")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("true_label"), pred.alias("pred_label"))


_REPORT = f"""
p AS ({_PRED}), x AS (SELECT true_label AS label, 1 AS t, 0 AS p, CAST(true_label = pred_label AS INTEGER) AS hit FROM p UNION ALL SELECT pred_label, 0, 1, 0 FROM p),
s AS (SELECT label, sum(t) AS support, sum(p) AS predicted, sum(hit) AS tp FROM x GROUP BY 1),
r AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM s),
f AS (SELECT label, support, pr, re, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)"""


@query("class_report", f"WITH {_REPORT} SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f")
def class_report(spark, d):
    return rounded(E.class_report(_predictions(spark, d)))


@query("prediction_scores", f"WITH {_REPORT}, a AS (SELECT count(*) AS n, avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM p) SELECT n, round(accuracy, 6) AS accuracy, round((SELECT sum(f1) / count(*) FROM f), 6) AS macro_f1, round(accuracy, 6) AS micro_f1 FROM a")
def prediction_scores(spark, d):
    return rounded(E.scores(_predictions(spark, d)))


@query("confusion", f"WITH p AS ({_PRED}) SELECT true_label, pred_label, count(*) AS count FROM p GROUP BY 1, 2")
def confusion(spark, d):
    return E.confusion(_predictions(spark, d))


@query("predictions_normalised", f"WITH p AS ({_PRED}) SELECT CAST(id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS text, true_label, pred_label, true_label = pred_label AS correct FROM p")
def predictions_normalised(spark, d):
    p = _predictions(spark, d)
    return E.normalise_predictions(p.select(F.col("id").alias("graph_id"), F.col("true_label").alias("gold_label"), F.col("pred_label").alias("prediction"))).select("id", "text", "true_label", "pred_label", "correct")


@query("multi_label_scores", """
WITH m AS (SELECT [quality = 1, toxic = 1] AS t, [quality = 1, doc_id % 5 = 0] AS p FROM labels),
s AS (SELECT count(*) AS n, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS e, count(*) FILTER (WHERE t[1] AND p[1]) AS a1, count(*) FILTER (WHERE t[1] <> p[1]) AS o1, count(*) FILTER (WHERE t[2] AND p[2]) AS a2, count(*) FILTER (WHERE t[2] <> p[2]) AS o2 FROM m)
SELECT n, round(e, 6) AS exact_match, round(((CASE WHEN 2 * a1 + o1 > 0 THEN 2 * a1 / (2 * a1 + o1) ELSE 0 END) + (CASE WHEN 2 * a2 + o2 > 0 THEN 2 * a2 / (2 * a2 + o2) ELSE 0 END)) / 2, 6) AS macro_f1,
  round(2 * (a1 + a2) / (2 * (a1 + a2) + o1 + o2), 6) AS micro_f1 FROM s""")  # fmt: skip
def multi_label_scores(spark, d):
    flags = lambda a, b: F.array_compact(F.array(F.when(F.expr(a), F.lit("quality")), F.when(F.expr(b), F.lit("toxic"))))
    rows = table(spark, d, "labels").select(flags("quality = 1", "toxic = 1").alias("true_labels"), flags("quality = 1", "doc_id % 5 = 0").alias("pred_labels"))
    return rounded(E.multi_label_scores(rows, ["quality", "toxic"]))


@query("top_probabilities", "WITH x AS (SELECT o_orderkey AS id, unnest(['a', 'b', 'c', 'd']) AS label, unnest([o_totalprice % 7, o_totalprice % 11, o_totalprice % 13, o_totalprice % 17]) AS probability FROM orders) SELECT id, label, round(probability, 6) AS probability, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY probability DESC, label) AS INTEGER) AS rank FROM x) WHERE rank <= 3")
def top_probabilities(spark, d):
    p = F.create_map(*[x for i, m in enumerate((7, 11, 13, 17)) for x in (F.lit("abcd"[i]), F.col("o_totalprice") % m)])
    return rounded(E.top_probabilities(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), p.alias("probabilities"))))


@query("best_epochs", """
WITH l AS (SELECT l_returnflag AS model, l_linenumber AS epoch, round(avg(l_discount), 4) AS f1, round(avg(l_tax), 4) AS accuracy FROM lineitem GROUP BY 1, 2)
SELECT model, arg_max(epoch, (f1, -epoch)) AS best_epoch, max(f1) AS best_f1, arg_max(accuracy, (f1, -epoch)) AS best_accuracy, max(epoch) AS last_epoch, arg_max(f1, epoch) AS last_f1 FROM l GROUP BY 1""")  # fmt: skip
def best_epochs(spark, d):
    log = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_discount"), 4).alias("f1"), F.round(F.avg("l_tax"), 4).alias("accuracy"))
    return E.best_epochs(log)


@query("error_table", f"WITH p AS ({_PRED}), e AS (SELECT *, CASE id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS model FROM p WHERE true_label <> pred_label) SELECT true_label, count(*) FILTER (WHERE model = 'even') AS even, count(*) FILTER (WHERE model = 'odd') AS odd, count(*) AS total FROM e GROUP BY 1")
def error_table(spark, d):
    errors = _predictions(spark, d).where("true_label <> pred_label").withColumn("model", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return E.error_table(errors, ["even", "odd"])


@query("label_space", f"WITH p AS ({_PRED}) SELECT true_label AS label FROM p UNION SELECT pred_label FROM p")
def label_space(spark, d):
    p = _predictions(spark, d)
    return E.label_space(p.select("true_label"), p.select("pred_label"))
