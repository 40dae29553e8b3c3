"""Queries: label mapping, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import hierarchy as H
from spanloom.operators import labels as L
from spanloom.operators import relations as R
from spanloom.plans.registry import query, rounded, table

# A raw label per part name's word; the codebook maps some words to codes and some to subcodes.
_WORDS = "SELECT p_partkey AS id, string_split(p_name, ' ') AS codes FROM part"
_MAP = "SELECT w AS raw, upper(w) AS matched_codebook_label, CASE WHEN length(w) % 2 = 0 THEN 'code' ELSE 'subcode' END AS level FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) <> 5"


def _words(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("codes"))


def _mapping(spark, d):
    w = _words(spark, d).select(F.explode("codes").alias("raw")).distinct().where("length(raw) <> 5")
    return w.select("raw", F.upper("raw").alias("matched_codebook_label"), F.when(F.length("raw") % 2 == 0, "code").otherwise("subcode").alias("level"))


@query("positional_labels", f"WITH w AS ({_WORDS}) SELECT id, codes[1] AS code, codes[2] AS subcode, CASE WHEN len(codes) >= 2 THEN codes[1] || ' → ' || codes[2] ELSE codes[1] END AS combined FROM w")
def positional_labels(spark, d):
    return _words(spark, d).select("id", *[L.positional_label(F.col("codes"), level).alias(level) for level in ("code", "subcode", "combined")])


@query("mapped_labels", f"""
WITH w AS ({_WORDS}), m AS ({_MAP}), x AS (SELECT id, unnest(codes) AS raw, unnest(range(len(codes))) AS pos FROM w)
SELECT id, arg_min(matched_codebook_label, pos) FILTER (WHERE level = 'code') AS code, arg_min(matched_codebook_label, pos) FILTER (WHERE level = 'subcode') AS subcode
FROM x LEFT JOIN m ON x.raw = m.raw GROUP BY id""")  # fmt: skip
def mapped_labels(spark, d):
    return L.mapped_labels(_words(spark, d), _mapping(spark, d))


@query("preferred_and_combined_labels", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END) AS preferred, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN NULL ELSE coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, '∅') || '||' || coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '∅') END AS combined FROM orders")
def preferred_and_combined_labels(spark, d):
    code, sub = F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END"), F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(sub, code).alias("preferred"), L.combined_label(code, sub).alias("combined"))


@query("robust_lookup", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS found FROM customer")
def robust_lookup(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.robust_lookup(F.col("c_mktsegment"), {"building": "b", "MACHINERY": "m"}).alias("found"))


@query("labels_mapped_three_ways", f"""
WITH w AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS raw FROM part), m AS ({_MAP})
SELECT id, coalesce(matched_codebook_label, w.raw) AS kept, coalesce(matched_codebook_label, '[UNKNOWN:' || w.raw || ']') AS marked, matched_codebook_label IS NOT NULL AS stays FROM w LEFT JOIN m ON w.raw = m.raw""")  # fmt: skip
def labels_mapped_three_ways(spark, d):
    rows, m = _words(spark, d).select("id", F.get("codes", 0).alias("raw")), _mapping(spark, d)
    kept = L.map_labels(rows, m, "raw", "keep").select("id", F.col("mapped").alias("kept"))
    marked = L.map_labels(rows, m, "raw", "mark").select("id", F.col("mapped").alias("marked"))
    stays = L.map_labels(rows, m, "raw", "drop").select("id", F.lit(True).alias("stays"))
    return kept.join(marked, "id").join(stays, "id", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))


@query("dropped_label_count", f"WITH w AS (SELECT split_part(p_name, ' ', 1) AS raw FROM part), m AS ({_MAP}) SELECT count(*) AS dropped FROM w WHERE lower(raw) NOT IN (SELECT lower(raw) FROM m)")
def dropped_label_count(spark, d):
    return R.mapped_or_counted(_words(spark, d).select("id", F.get("codes", 0).alias("raw")), _mapping(spark, d), "raw")[1]


_TYPES = "SELECT matched_codebook_label AS label, CASE WHEN ascii(matched_codebook_label) % 2 = 0 THEN 'Interactional' ELSE 'GoalOriented' END AS intent_type FROM m"


@query("intent_types", f"""
WITH w AS ({_WORDS}), m AS ({_MAP}), t AS ({_TYPES}), x AS (SELECT id, upper(unnest(codes)) AS label FROM w)
SELECT id, coalesce(list_sort(list(DISTINCT intent_type) FILTER (WHERE intent_type IS NOT NULL)), []) AS label_type FROM x LEFT JOIN t ON x.label = t.label GROUP BY id""")  # fmt: skip
def intent_types(spark, d):
    m = _mapping(spark, d)
    types = m.select(F.col("matched_codebook_label").alias("label"), F.when(F.ascii("matched_codebook_label") % 2 == 0, "Interactional").otherwise("GoalOriented").alias("intent_type"))
    rows = _words(spark, d).select("id", F.transform("codes", lambda c: F.upper(c)).alias("labels"))
    return L.intent_types(rows, types, "id", "labels")


@query("units_without_removed_labels", f"WITH w AS ({_WORDS}) SELECT id, codes FROM w WHERE NOT list_has_any(codes, ['small', 'ring'])")
def units_without_removed_labels(spark, d):
    return L.drop_removed(_words(spark, d), "codes", spark.createDataFrame([("small",), ("ring",)], "label string"))


@query("allowed_labels", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def allowed_labels(spark, d):
    return L.only_allowed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "label string"))


@query("labels_split_by_level", f"""
WITH w AS ({_WORDS}), x AS (SELECT id, unnest(codes) AS label, unnest(range(len(codes))) AS pos FROM w)
SELECT id, CASE length(label) % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'subcode' ELSE 'other' END AS level, list(label ORDER BY pos, label) AS labels FROM x WHERE length(label) % 3 < 2 GROUP BY 1, 2""")  # fmt: skip
def labels_split_by_level(spark, d):
    level = lambda c: F.when(F.length(c) % 3 == 0, "code").when(F.length(c) % 3 == 1, "subcode").otherwise("other")
    return L.split_by_level(_words(spark, d).select("id", F.transform("codes", lambda c: F.struct(c.alias("label"), level(c).alias("level"))).alias("labels")))


def _messages(spark, d):
    a = F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit("_0")).alias("text_id"), F.col("p_name").alias("text"), F.split("p_name", " ").alias("code"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("message_id"), F.array(a).alias("annotations"))


@query("annotations_split_by_type", f"""
WITH w AS ({_WORDS}), x AS (SELECT id, list_filter(codes, lambda c: c IN ('small', 'large')) AS a, list_filter(codes, lambda c: c IN ('ring', 'bolt')) AS b FROM w)
SELECT id AS message_id, 'size' AS intent_type, a AS codes FROM x WHERE len(a) > 0 UNION ALL SELECT id, 'thing', b FROM x WHERE len(b) > 0""")  # fmt: skip
def annotations_split_by_type(spark, d):
    out = L.split_by_type(_messages(spark, d), {"small": "size", "large": "size", "ring": "thing", "bolt": "thing"}, ["size", "thing"])
    return out.select("message_id", "intent_type", F.flatten("annotations.code").alias("codes"))


@query("annotations_split_by_flag", "SELECT p_partkey AS message_id, length(p_name) > 10 AS is_cross FROM part")
def annotations_split_by_flag(spark, d):
    return L.split_by_flag(_messages(spark, d), lambda t: F.length(t) > 10).select("message_id", "is_cross")


@query("labels_without_rare", "SELECT n_nationkey, s_suppkey FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n > 3")
def labels_without_rare(spark, d):
    return L.drop_rare(table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), "n_nationkey", 3)


@query("alias_hits", "WITH r AS (SELECT DISTINCT p_type AS raw FROM part) SELECT 'cheap' AS target, raw FROM r WHERE lower(raw) = 'economy' OR regexp_matches(raw, '(?i)^pro') UNION SELECT 'plain' AS target, raw FROM r WHERE regexp_matches(raw, '(?i)stan|small')")
def alias_hits(spark, d):
    rules = spark.createDataFrame([("cheap", "exact", "Economy"), ("cheap", "regex", "^pro"), ("plain", "regex", "stan|small")], "target string, kind string, pattern string")
    return L.alias_hits(table(spark, d, "part"), rules, "p_type")


@query("alias_verification", "WITH r AS (SELECT p_type AS raw FROM part), h AS (SELECT 'cheap' AS target, raw FROM r WHERE lower(raw) = 'economy' OR regexp_matches(raw, '(?i)^pro') UNION ALL SELECT 'plain', raw FROM r WHERE regexp_matches(raw, '(?i)stan|small')) SELECT target, raw, count(*) AS count FROM h GROUP BY 1, 2")
def alias_verification(spark, d):
    raws = table(spark, d, "part").select(F.col("p_type").alias("raw"))
    return raws.join(L.small(alias_hits(spark, d)), "raw").groupBy("target", "raw").agg(F.count("*").alias("count"))


@query("alias_contributions", "WITH h AS (SELECT p_type AS target, p_brand AS raw, count(*) AS n FROM part GROUP BY 1, 2) SELECT target, sum(n)::BIGINT AS total, count(DISTINCT raw) AS n_subcodes, string_agg(DISTINCT raw, '; ' ORDER BY raw) AS subcodes FROM h GROUP BY 1")
def alias_contributions(spark, d):
    h = table(spark, d, "part").groupBy(F.col("p_type").alias("target"), F.col("p_brand").alias("raw")).agg(F.count("*").alias("n"))
    return h.groupBy("target").agg(F.sum("n").alias("total"), F.countDistinct("raw").alias("n_subcodes"), F.array_join(F.array_sort(F.collect_set("raw")), "; ").alias("subcodes"))


# joins


@query("units_with_annotations", "SELECT c_custkey AS unit_id, list_sort(list(o_orderpriority)) AS values FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def units_with_annotations(spark, d):
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_custkey").alias("k"))
    return R.attach_all(units, table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority"), ["k"], "o_orderpriority")


@query("last_occurrence_wins", "SELECT c_custkey, (SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o_orderpriority FROM customer")
def last_occurrence_wins(spark, d):
    return R.attach_last(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderpriority", "o_orderkey")


_RATES = "SELECT c_nationkey AS label, round(avg(c_acctbal), 6) AS rate, count(*) AS n FROM customer GROUP BY 1"


@query("methods_side_by_side", f"""
WITH a AS ({_RATES} HAVING c_nationkey % 3 > 0), b AS (SELECT s_nationkey AS label, round(avg(s_acctbal), 6) AS rate, count(*) AS n FROM supplier GROUP BY 1 HAVING s_nationkey % 4 > 0),
j AS (SELECT coalesce(a.label, b.label) AS label, a.rate AS rate_lsa, a.n AS n_lsa, b.rate AS rate_sbert, b.n AS n_sbert FROM a FULL JOIN b ON a.label = b.label)
SELECT *, greatest(rate_lsa, rate_sbert) AS max_value, CASE WHEN rate_lsa IS NOT NULL AND (rate_sbert IS NULL OR rate_lsa >= rate_sbert) THEN 'rate_lsa' WHEN rate_sbert IS NOT NULL THEN 'rate_sbert' END AS max_column,
       coalesce(n_lsa, 0) + coalesce(n_sbert, 0) AS total FROM j""")  # fmt: skip
def methods_side_by_side(spark, d):
    a = rounded(table(spark, d, "customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("label")).agg(F.avg("c_acctbal").alias("rate"), F.count("*").alias("n")))
    b = rounded(table(spark, d, "supplier").where("s_nationkey % 4 > 0").groupBy(F.col("s_nationkey").alias("label")).agg(F.avg("s_acctbal").alias("rate"), F.count("*").alias("n")))
    out = R.side_by_side({"lsa": a, "sbert": b}, ["label"], ["rate", "n"])
    return R.row_sum(R.row_argmax(out, ["rate_lsa", "rate_sbert"]), ["n_lsa", "n_sbert"])


@query("same_label_pairs", "SELECT a.conv_id, a.role, a.turn AS source, b.turn AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn <> b.turn")
def same_label_pairs(spark, d):
    return R.same_label_pairs(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("clause_neighbours", "SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_id FROM conversations")
def clause_neighbours(spark, d):
    return R.neighbours(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("message_chains", "SELECT CAST(conv_id AS VARCHAR) AS g, CAST(0 AS BIGINT) AS chain, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, turn AS pos, CAST(turn AS VARCHAR) AS context FROM conversations")
def message_chains(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").cast("string").alias("context"), (F.col("turn") + 1).cast("string").alias("next"))
    return R.chains(rows, "conv_id")


@query("labels_across_methods", "SELECT conv_id, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT role) > 1)")
def labels_across_methods(spark, d):
    return R.repeated_across(table(spark, d, "conversations").select("conv_id", "role"), "conv_id", "role")


@query("model_outcomes", """
WITH a AS (SELECT l_partkey AS text, arg_max(l_quantity > 10, l_orderkey * 10 + l_linenumber) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS text, arg_max(l_discount > 0.05, l_orderkey * 10 + l_linenumber) AS y FROM lineitem GROUP BY 1)
SELECT CASE WHEN x AND y THEN 'Both Correct' WHEN x THEN 'Only Sentence Correct' WHEN y THEN 'Only Clause Correct' ELSE 'Both Wrong' END AS outcome, count(*) AS count FROM a JOIN b ON a.text = b.text GROUP BY 1""")  # fmt: skip
def model_outcomes(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    a = rows.select(F.col("l_partkey").alias("text"), (F.col("l_quantity") > 10).alias("correct"), "ord")
    b = rows.select(F.col("l_partkey").alias("text"), (F.col("l_discount") > 0.05).alias("correct"), "ord")
    return R.compare_models(a, b).groupBy("outcome").agg(F.count("*").alias("count"))


@query("to_do_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def to_do_ids(spark, d):
    return R.to_do(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("features_or_zero", "SELECT doc_id, CASE WHEN quality IS NULL THEN [0.0, 0.0] ELSE [CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)] END AS features FROM documents LEFT JOIN labels USING (doc_id)")
def features_or_zero(spark, d):
    f = table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("features"))
    return R.attach_or_zero(table(spark, d, "documents").select("doc_id"), f, "doc_id", 2)


@query("graph_labels", f"WITH w AS ({_WORDS}), x AS (SELECT id, list_filter(codes, lambda c: length(c) % 2 = 1) AS s FROM w) SELECT CAST(id AS VARCHAR) AS graph_id, s[1] AS label FROM x WHERE len(s) > 0")
def graph_labels(spark, d):
    level = lambda c: F.when(F.length(c) % 2 == 1, "subcode").otherwise("code")
    units = _words(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("").alias("text"), F.transform("codes", lambda c: F.struct(c.alias("label"), level(c).alias("level"))).alias("labels"))
    return R.graph_labels(units.select(F.col("id").alias("graph_id")), units).drop("text")


@query("label_union_tagged", "SELECT 'nation' AS method, n_name AS label FROM nation UNION ALL SELECT 'region', r_name FROM region")
def label_union_tagged(spark, d):
    a = table(spark, d, "nation").select(F.lit("nation").alias("method"), F.col("n_name").alias("label"))
    return a.unionByName(table(spark, d, "region").select(F.lit("region").alias("method"), F.col("r_name").alias("label")))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("one_hot_labels", f"WITH w AS ({_WORDS}) SELECT id, CAST(list_contains(codes, 'small') AS INTEGER) AS small, CAST(list_contains(codes, 'ring') AS INTEGER) AS ring FROM w")
def one_hot_labels(spark, d):
    return L.one_hot(_words(spark, d), "codes", ["small", "ring"]).drop("codes")


# hierarchy: region, nation, customer

_EDGES = "SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"
_NODES = "SELECT 'r' || r_regionkey AS id, 'code' AS type, r_regionkey AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, 'subcode', 100 + n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'subsubcode', 1000 + c_custkey FROM customer"


def _tree(spark, d):
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    edges = n.selectExpr("'r' || n_regionkey AS source", "'n' || n_nationkey AS target").unionByName(c.selectExpr("'n' || c_nationkey AS source", "'c' || c_custkey AS target"))
    nodes = r.selectExpr("'r' || r_regionkey AS id", "'code' AS type", "CAST(r_regionkey AS BIGINT) AS ord")
    nodes = nodes.unionByName(n.selectExpr("'n' || n_nationkey AS id", "'subcode' AS type", "CAST(100 + n_nationkey AS BIGINT) AS ord")).unionByName(c.selectExpr("'c' || c_custkey AS id", "'subsubcode' AS type", "1000 + c_custkey AS ord"))
    return nodes, edges


@query("children_numbered", f"WITH e AS ({_EDGES}) SELECT source, target, CAST(row_number() OVER (PARTITION BY source ORDER BY target) AS INTEGER) AS number FROM e")
def children_numbered(spark, d):
    return H.number_children(_tree(spark, d)[1])


@query("path_index", f"""
WITH RECURSIVE e AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM ({_EDGES})), r AS (SELECT id, type, row_number() OVER (ORDER BY id) AS n FROM ({_NODES}) WHERE type = 'code'),
w AS (SELECT id, CAST(n AS VARCHAR) AS index, 1 AS depth FROM r UNION ALL SELECT e.target, w.index || '_' || CAST(e.n AS VARCHAR), w.depth + 1 FROM w JOIN e ON e.source = w.id)
SELECT w.id, x.type, w.index, w.depth FROM w JOIN ({_NODES}) x ON x.id = w.id""")  # fmt: skip
def path_index(spark, d):
    return H.path_index(*_tree(spark, d))


@query("subtree_of_keyword", f"WITH RECURSIVE w AS (SELECT 'n1' AS id UNION SELECT e.target FROM w JOIN ({_EDGES}) e ON e.source = w.id) SELECT id FROM w")
def subtree_of_keyword(spark, d):
    return H.subtree(*_tree(spark, d), "N1")


@query("subtree_sizes", f"WITH RECURSIVE w AS (SELECT id AS root, id FROM ({_NODES}) UNION SELECT w.root, e.target FROM w JOIN ({_EDGES}) e ON e.source = w.id) SELECT root, count(*) AS size FROM w GROUP BY 1")
def subtree_sizes(spark, d):
    return H.subtrees(*_tree(spark, d)).groupBy("root").agg(F.count("*").alias("size"))


@query("filled_down", "SELECT r_regionkey, last_value(CASE WHEN r_regionkey % 2 = 0 THEN r_name END IGNORE NULLS) OVER (ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name FROM region")
def filled_down(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", F.expr("CASE WHEN r_regionkey % 2 = 0 THEN r_name END").alias("name"))
    return H.fill_down(rows, ["name"], "r_regionkey")


@query("graph_labels_last", f"WITH w AS ({_WORDS}) SELECT CAST(id AS VARCHAR) AS graph_id, codes[len(codes)] AS label FROM w WHERE len(codes) > 0")
def graph_labels_last(spark, d):
    """The last label of any level."""
    level = lambda c: F.when(F.length(c) % 2 == 1, "subcode").otherwise("code")
    units = _words(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("").alias("text"), F.transform("codes", lambda c: F.struct(c.alias("label"), level(c).alias("level"))).alias("labels"))
    return R.graph_labels(units.select(F.col("id").alias("graph_id")), units, "last").drop("text")


_UNITS = """
t AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn % 3 = 1 AND coalesce(text, '') <> '' AS has FROM conversations),
u AS (SELECT conv_id, turn, unnest(string_split(text, ', ')) AS piece, unnest(range(len(string_split(text, ', ')))) AS k FROM t),
k AS (SELECT *, length(piece) % 4 = 0 AND piece <> '' AS has FROM u),
m AS (SELECT conv_id FROM t WHERE has UNION SELECT conv_id FROM k WHERE has)"""


@query("annotated_units", f"""WITH {_UNITS}
    SELECT 'message' AS level, CAST(conv_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS span FROM m
    UNION ALL SELECT 'sentence', conv_id || '_' || turn, substr(text, 1, 5) FROM t WHERE has
    UNION ALL SELECT 'subsentence', conv_id || '_' || turn || '_' || k, piece FROM k WHERE has""")
def annotated_units(spark, d):
    """Conversations as messages, turns as sentences, their parts between commas as subsentences; some of each have a span."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda *c: F.concat_ws("_", *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in c])
    piece = lambda p, k: F.struct(name("conv_id", "turn", k).alias("subsentence_id"), p.alias("subsentence"), F.when(F.length(p) % 4 == 0, p).alias("most_close_annotation_span"))
    span = F.when(F.col("turn") % 3 == 1, F.substring("text", 1, 5)).alias("most_close_annotation_span")
    sentence = F.struct(name("conv_id", "turn").alias("sentence_id"), F.col("text").alias("sentence"), span, F.transform(F.split("text", ", ", -1), piece).alias("subsentences"))
    messages = t.groupBy(F.col("conv_id").alias("message_id")).agg(F.lit("").alias("message"), F.collect_list(sentence).alias("sentences"))
    return R.annotated_units(messages).select("level", "id", "span")


@query("columns_normalised", 'SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey AS region FROM nation')
def columns_normalised(spark, d):
    messy = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toDF(" Nation-Key ", "NAME", "Region  Number")
    return L.strip_columns(messy, {"region_number": "region"})


@query("columns_found", "SELECT * FROM (VALUES (0, 'n_name', 'label;name'), (1, CAST(NULL AS VARCHAR), 'label;name;true_label'), (2, 'n_regionkey', '')) v(k, found, missing)")
def columns_found(spark, d):
    """The first of some names that a table has, and all that it lacks."""
    n = table(spark, d, "nation")
    wanted = [["label", "n_name", "name"], ["label", "name", "true_label"], ["n_regionkey", "n_name"]]
    rows = [(k, L.find_column(n, names), ";".join(L.missing_columns(n, names))) for k, names in enumerate(wanted)]
    return spark.createDataFrame(rows, "k int, found string, missing string")
