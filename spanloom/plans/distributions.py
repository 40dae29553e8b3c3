"""Queries: counts, imbalance, coverage, spans' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import distributions as D
from spanloom.operators import labels as L
from spanloom.operators import spans as S
from spanloom.plans.registry import query, rounded, table


def _imbalance_sql(counts: str) -> str:
    return f"""
WITH c AS ({counts}), t AS (SELECT sum(count) AS t FROM c), p AS (SELECT count, count / t AS p FROM c, t)
SELECT count(*) AS k, CAST(coalesce(sum(count), 0) AS BIGINT) AS total, round(max(count) / min(count), 6) AS ir_max,
       round(stddev_pop(count) / avg(count), 6) AS cv, round(-sum(p * ln(p + 1e-12)), 6) AS h,
       round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p + 1e-12)) / ln(count(*)) WHEN count(*) = 1 THEN 0 END, 6) AS h_norm,
       round(1 - sum(p * p), 6) AS gini, round(1 / sum(p * p), 6) AS n_eff, max(count) AS max_count, min(count) AS min_count
FROM p"""


_COUNTS = "SELECT {c} AS label, count(*) AS count FROM {t} WHERE {c} IS NOT NULL GROUP BY 1"


@query("label_imbalance_source", _imbalance_sql(_COUNTS.format(c="source", t="documents")))
def label_imbalance_source(spark, d):
    return rounded(D.imbalance(D.label_counts(table(spark, d, "documents"), "source")))


@query("label_imbalance_priority", _imbalance_sql(_COUNTS.format(c="o_orderpriority", t="orders")))
def label_imbalance_priority(spark, d):
    return rounded(D.imbalance(D.label_counts(table(spark, d, "orders"), "o_orderpriority")))


@query("label_imbalance_empty", _imbalance_sql(_COUNTS.format(c="event_type", t="events") + " HAVING false"))
def label_imbalance_empty(spark, d):
    return rounded(D.imbalance(D.label_counts(table(spark, d, "events").where("false"), "event_type")))


@query("label_counts", _COUNTS.format(c="event_type", t="events"))
def label_counts(spark, d):
    return D.label_counts(table(spark, d, "events"), "event_type")


@query("most_common_labels", "SELECT p_type AS label, count(*) AS count, min(p_partkey) AS first FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 20")
def most_common_labels(spark, d):
    return D.most_common(table(spark, d, "part"), "p_type", "p_partkey", 20)


_CODES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS code, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS sub FROM orders"


def _codes(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS code", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS sub")


@query("combined_label_counts", f"WITH x AS ({_CODES}) SELECT CASE WHEN code IS NOT NULL AND sub IS NOT NULL THEN code || '_' || sub ELSE coalesce(code, sub) END AS label, count(*) AS count FROM x GROUP BY 1 HAVING label IS NOT NULL")
def combined_label_counts(spark, d):
    return D.label_counts(_codes(spark, d), L.counting_label(F.col("code"), F.col("sub")))


@query(
    "split_label_counts",
    f"""WITH x AS ({_CODES}) SELECT CASE WHEN sub = 'F' AND code IS NOT NULL THEN code || '_' || sub WHEN sub = 'F' THEN sub WHEN code IN ('1-URGENT', '2-HIGH') AND sub IS NULL THEN code END AS label,
    count(*) AS count FROM x GROUP BY 1 HAVING label IS NOT NULL""",
)
def split_label_counts(spark, d):
    return D.label_counts(_codes(spark, d), L.split_label(F.col("code"), F.col("sub"), ["F", "1-URGENT", "2-HIGH"]))


_FLAT = "CASE WHEN sub = 'F' THEN sub WHEN code IN ('1-URGENT', '2-HIGH') THEN code END"


@query("flat_label_counts", f"WITH x AS ({_CODES}) SELECT {_FLAT} AS label, count(*) AS count FROM x GROUP BY 1 HAVING label IS NOT NULL")
def flat_label_counts(spark, d):
    return D.label_counts(_codes(spark, d), L.flat_label(F.col("code"), F.col("sub"), ["F", "1-URGENT", "2-HIGH"]))


@query(
    "type_comparison",
    f"SELECT 'first' AS type, * FROM ({_imbalance_sql(f'WITH x AS ({_CODES}) SELECT {_FLAT} AS label, count(*) AS count FROM x GROUP BY 1 HAVING label IS NOT NULL')}) UNION ALL SELECT 'second' AS type, * FROM ({_imbalance_sql(_COUNTS.format(c='event_type', t='events'))})",
)
def type_comparison(spark, d):
    return rounded(D.compare_types({"first": flat_label_counts(spark, d), "second": label_counts(spark, d)}))


_PATHS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey"


@query(
    "path_coverage",
    f"""SELECT r_name, n_name, c_mktsegment, count(DISTINCT c_custkey) AS coverage, count(*) AS frequency, CAST(grouping(r_name, n_name, c_mktsegment) AS BIGINT) AS level_bits
    FROM {_PATHS} GROUP BY GROUPING SETS ((r_name), (n_name), (c_mktsegment), (r_name, n_name), (r_name, n_name, c_mktsegment))""",
)
def path_coverage(spark, d):
    c, n, r, o = (table(spark, d, x) for x in ("customer", "nation", "region", "orders"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    sets = [["r_name"], ["n_name"], ["c_mktsegment"], ["r_name", "n_name"], ["r_name", "n_name", "c_mktsegment"]]
    return D.path_coverage(rows, ["r_name", "n_name", "c_mktsegment"], "c_custkey", sets)


@query("unmapped_labels", "SELECT DISTINCT p_brand AS label FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size > 40) ORDER BY 1 LIMIT 30")
def unmapped_labels(spark, d):
    part = table(spark, d, "part")
    return D.unmapped(part, "p_brand", part.where("p_type = 'ECONOMY' AND p_size > 40").select("p_brand"))


@query(
    "label_cross_tab",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
)
def label_cross_tab(spark, d):
    return D.cross_tab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("label_percent", "SELECT c_mktsegment AS label, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def label_percent(spark, d):
    return rounded(D.percent(table(spark, d, "customer"), "c_mktsegment"))


@query(
    "matches_per_unit",
    "WITH n AS (SELECT c_custkey, count(o_orderkey) AS n_matches FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT n_matches, count(*) AS n_units FROM n GROUP BY 1",
)
def matches_per_unit(spark, d):
    return D.per_unit_histogram(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(
    "codebook_frequencies",
    """WITH f AS (SELECT p_brand, p_type, count(*) AS frequency FROM part WHERE p_size > 25 GROUP BY 1, 2), b AS (SELECT DISTINCT p_brand, p_type FROM part)
    SELECT b.p_brand, b.p_type, coalesce(frequency, 0) AS frequency FROM b LEFT JOIN f ON b.p_brand = f.p_brand AND b.p_type = f.p_type""",
)
def codebook_frequencies(spark, d):
    part = table(spark, d, "part")
    counts = part.where("p_size > 25").groupBy("p_brand", "p_type").agg(F.count("*").alias("frequency"))
    return D.with_frequencies(part.select("p_brand", "p_type").distinct(), counts, ["p_brand", "p_type"])


@query(
    "duplicates_collapsed",
    """WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS kept FROM part GROUP BY 1, 2), i AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY kept) AS INTEGER) AS new_index FROM f)
    SELECT p.p_brand, p.p_type, p.p_partkey, kept, new_index FROM part p JOIN i ON p.p_brand = i.p_brand AND p.p_type = i.p_type""",
)
def duplicates_collapsed(spark, d):
    return D.duplicates_collapsed(table(spark, d, "part"), "p_brand", "p_type", "p_partkey")


_FLAGS = "l_quantity > 25 AS many, l_discount > 0.05 AS cheap, l_tax > 0.04 AS taxed"


@query(
    "flag_combinations",
    f"""WITH x AS (SELECT l_linestatus, {_FLAGS} FROM lineitem)
    SELECT concat_ws('+', CASE WHEN many THEN 'many' END, CASE WHEN cheap THEN 'cheap' END, CASE WHEN taxed THEN 'taxed' END) AS combo, l_linestatus, count(*) AS count FROM x GROUP BY 1, 2""",
)
def flag_combinations(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_linestatus", *_FLAGS.split(", "))
    return D.flag_combinations(rows, ["many", "cheap", "taxed"], "l_linestatus")


_LEVELS = "CASE p_size % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'subcode' ELSE 'subsubcode' END"


@query("level_counts", f"SELECT {_LEVELS} AS level, count(*) AS count FROM part GROUP BY 1")
def level_counts(spark, d):
    rows = table(spark, d, "part").select(F.array(F.struct(F.col("p_type").alias("label"), F.expr(_LEVELS).alias("level"))).alias("labels"))
    return rows.select(F.explode("labels.level").alias("level")).groupBy("level").agg(F.count("*").alias("count"))


@query(
    "labels_by_unit_level",
    "SELECT role, count(*) FILTER (WHERE turn = 0) AS messages, count(*) FILTER (WHERE turn BETWEEN 1 AND 2) AS sentences, count(*) FILTER (WHERE turn > 2) AS subsentences FROM conversations GROUP BY 1",
)
def labels_by_unit_level(spark, d):
    t = table(spark, d, "conversations")
    return t.groupBy("role").agg(F.count_if(F.col("turn") == 0).alias("messages"), F.count_if(F.col("turn").between(1, 2)).alias("sentences"), F.count_if(F.col("turn") > 2).alias("subsentences"))


# spans: lengths of turns

_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+|-{2,}|[^\sA-Za-z0-9'']'))"


def _lengths(spark, d):
    from spanloom.functions.text import tokens

    return table(spark, d, "conversations").select("role", F.size(tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


_QUARTILES = """
q AS (SELECT {by} list_sort(list(n)) AS v, count(*) AS m FROM x {group}),
r AS (SELECT *, least(greatest((m + 1) // 4, 1), m - 1) AS j1, least(greatest(3 * (m + 1) // 4, 1), m - 1) AS j3 FROM q),
i AS (SELECT {by} CASE WHEN m >= 4 THEN (v[j3] * (4 - (3 * (m + 1) - 4 * j3)) + v[j3 + 1] * (3 * (m + 1) - 4 * j3)) / 4.0 - (v[j1] * (4 - ((m + 1) - 4 * j1)) + v[j1 + 1] * ((m + 1) - 4 * j1)) / 4.0 END AS iqr FROM r)"""
_STATS = "count(n) AS n, min(n) AS min, max(n) AS max, median(n) AS median, round(avg(n), 6) AS mean, round(stddev_pop(n) / avg(n), 6) AS cv"


@query("span_length_stats", f"WITH x AS (SELECT {_TOKENS} AS n FROM conversations), {_QUARTILES.format(by='', group='')} SELECT {_STATS}, (SELECT iqr FROM i) AS iqr FROM x")
def span_length_stats(spark, d):
    return rounded(S.length_stats(_lengths(spark, d), "n"), "mean", "cv")


@query("span_length_by_label", f"WITH x AS (SELECT role, {_TOKENS} AS n FROM conversations), {_QUARTILES.format(by='role,', group='GROUP BY role')} SELECT x.role, {_STATS}, any_value(iqr) AS iqr FROM x JOIN i ON x.role = i.role GROUP BY x.role")
def span_length_by_label(spark, d):
    return rounded(S.length_stats(_lengths(spark, d), "n", ["role"]), "mean", "cv")


_BUCKET = "CASE WHEN n BETWEEN 1 AND 2 THEN '1-2' WHEN n BETWEEN 3 AND 5 THEN '3-5' WHEN n BETWEEN 6 AND 10 THEN '6-10' WHEN n BETWEEN 11 AND 20 THEN '11-20' WHEN n >= 21 THEN '21-+' ELSE 'other' END"


@query(
    "span_length_buckets",
    f"WITH x AS (SELECT {_TOKENS} AS n FROM conversations), c AS (SELECT {_BUCKET} AS bucket, count(*) AS c FROM x GROUP BY 1), b AS (SELECT unnest(['1-2', '3-5', '6-10', '11-20', '21-+']) AS bucket) SELECT coalesce(b.bucket, c.bucket) AS bucket, coalesce(c, 0) AS count FROM b FULL JOIN c ON b.bucket = c.bucket",
)
def span_length_buckets(spark, d):
    return S.bucket_counts(_lengths(spark, d), "n")


@query(
    "span_bucket_shares",
    f"WITH x AS (SELECT role, {_TOKENS} AS n FROM conversations), y AS (SELECT role, {_BUCKET} AS b FROM x) SELECT role, " + ", ".join(f"round(avg(CASE WHEN b = '{b}' THEN 1.0 ELSE 0.0 END), 6) AS \"share_{b}\"" for b in ("1-2", "3-5", "6-10", "11-20", "21-+")) + " FROM y GROUP BY 1",
)
def span_bucket_shares(spark, d):
    return rounded(S.bucket_shares(_lengths(spark, d), "n", "role"))
