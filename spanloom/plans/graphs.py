"""Queries: clause graphs of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import graphs as G
from spanloom.plans.registry import query, rounded, table

_ID = "conv_id || '_' || lpad(CAST(turn AS VARCHAR), 5, '0')"
_CLAUSES = f"c AS (SELECT conv_id AS message, {_ID} AS id, role AS label, coalesce(text, '') AS text FROM conversations)"
_CUE = {k: "(" + " OR ".join(f"contains(lower(text), '{c}')" for c in v) + ")" for k, v in X.CUES.items()}
_EGO = f"""{_CLAUSES}, w AS (SELECT *, lead(id) OVER (PARTITION BY message ORDER BY id) AS nx, lag(id) OVER (PARTITION BY message ORDER BY id) AS pv FROM c),
e AS (SELECT id AS graph_id, id AS source, id AS target, 'self' AS label, CAST(1.0 AS DOUBLE) AS weight FROM w
  UNION ALL SELECT id, id, nx, 'next', 0.8 FROM w WHERE nx IS NOT NULL UNION ALL SELECT id, pv, id, 'prev', 0.8 FROM w WHERE pv IS NOT NULL
  UNION ALL SELECT id, id, nx, 'elaboration', 0.6 FROM w WHERE nx IS NOT NULL AND {_CUE['elaboration']} UNION ALL SELECT id, id, nx, 'contrast', 0.5 FROM w WHERE nx IS NOT NULL AND {_CUE['contrast']}
  UNION ALL SELECT a.id, a.id, b.id, 'same_label', 0.7 FROM c a JOIN c b ON a.message = b.message AND a.label = b.label AND a.id <> b.id)"""


def _clauses(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("message"), F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("id"), F.col("role").alias("label"), F.coalesce("text", F.lit("")).alias("text")
    )


@query("next_graph", f"WITH {_CLAUSES} SELECT * FROM (SELECT message AS graph_id, id AS source, lead(id) OVER (PARTITION BY message ORDER BY id) AS target, 'next' AS label FROM c) WHERE target IS NOT NULL")
def next_graph(spark, d):
    return G.next_edges(_clauses(spark, d), "message", "id")


@query("ego_graphs", f"WITH {_EGO} SELECT * FROM e")
def ego_graphs(spark, d):
    return G.ego_edges(_clauses(spark, d))


@query("ego_graph_nodes", f"WITH {_EGO} SELECT graph_id, source AS id FROM e UNION SELECT graph_id, target FROM e")
def ego_graph_nodes(spark, d):
    return G.ego_nodes(G.ego_edges(_clauses(spark, d)))


@query("message_ego_graphs", f"""
WITH {_CLAUSES}, s AS (SELECT * FROM (SELECT id AS source, lead(id) OVER (PARTITION BY message ORDER BY id) AS target FROM c) WHERE target IS NOT NULL)
SELECT source AS graph_id, source, target, 'next' AS label, CAST(0.8 AS DOUBLE) AS weight FROM s UNION ALL SELECT target, source, target, 'next', 0.8 FROM s
UNION ALL SELECT a.id, a.id, b.id, 'elaboration', 0.6 FROM (SELECT * FROM c WHERE {_CUE['elaboration']}) a JOIN c b ON a.message = b.message AND a.id <> b.id
UNION ALL SELECT a.id, a.id, b.id, 'contrast', 0.5 FROM (SELECT * FROM c WHERE {_CUE['contrast']}) a JOIN c b ON a.message = b.message AND a.id <> b.id""")  # fmt: skip
def message_ego_graphs(spark, d):
    return G.message_ego_edges(_clauses(spark, d), cues_to_all=True)


# one graph a conversation, for structure: turns, linked in order and by role

_GRAPH = f"""{_CLAUSES}, n AS (SELECT CAST(message AS VARCHAR) AS graph_id, id, label FROM c),
e AS (SELECT * FROM (SELECT CAST(message AS VARCHAR) AS graph_id, id AS source, lead(id) OVER (PARTITION BY message ORDER BY id) AS target, 'next' AS label FROM c) WHERE target IS NOT NULL
  UNION ALL SELECT CAST(a.message AS VARCHAR), a.id, b.id, 'same' FROM c a JOIN c b ON a.message = b.message AND a.label = b.label AND a.id <> b.id),
s AS (SELECT graph_id, least(source, target) AS u, greatest(source, target) AS v, min(label) AS label FROM e WHERE source <> target GROUP BY 1, 2, 3)"""


def _graph(spark, d):
    c = _clauses(spark, d)
    nodes = c.select(F.col("message").cast("string").alias("graph_id"), "id", "label")
    a, b = c.select("message", "label", F.col("id").alias("source")), c.select("message", "label", F.col("id").alias("target"))
    same = a.join(b, ["message", "label"]).where("source <> target").select(F.col("message").cast("string").alias("graph_id"), "source", "target", F.lit("same").alias("label"))
    return nodes, G.next_edges(c, "message", "id").withColumn("graph_id", F.col("graph_id").cast("string")).unionByName(same)


@query("simple_graph_edges", f"WITH {_GRAPH} SELECT graph_id, u, v, label FROM s")
def simple_graph_edges(spark, d):
    return G.simple_edges(_graph(spark, d)[1])


@query("graph_sizes", f"""
WITH {_GRAPH}, a AS (SELECT graph_id, count(DISTINCT id) AS n_nodes FROM n GROUP BY 1), b AS (SELECT graph_id, count(*) AS m FROM s GROUP BY 1)
SELECT a.graph_id, n_nodes, coalesce(m, 0) AS n_edges, round(CASE WHEN n_nodes > 1 THEN 2 * coalesce(m, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 6) AS density, round(2 * coalesce(m, 0) / n_nodes, 6) AS avg_degree FROM a LEFT JOIN b ON a.graph_id = b.graph_id""")  # fmt: skip
def graph_sizes(spark, d):
    nodes, edges = _graph(spark, d)
    return rounded(G.sizes(nodes, G.simple_edges(edges)))


def _entropy(name: str, source: str) -> str:
    return f"{name} AS (SELECT graph_id, -sum(c / t * log2(c / t)) AS h FROM (SELECT graph_id, x, count(*) AS c, sum(count(*)) OVER (PARTITION BY graph_id) AS t FROM ({source}) GROUP BY 1, 2) GROUP BY 1)"


@query("graph_entropies", f"""
WITH {_GRAPH}, d AS (SELECT n.graph_id, n.id, count(s.u) AS x FROM n LEFT JOIN s ON s.graph_id = n.graph_id AND (s.u = n.id OR s.v = n.id) GROUP BY 1, 2),
{_entropy('hd', 'SELECT graph_id, x FROM d')}, {_entropy('hn', 'SELECT graph_id, label AS x FROM n')}, {_entropy('he', 'SELECT graph_id, label AS x FROM s')}
SELECT hd.graph_id, round(hd.h, 6) + 0.0 AS degree_entropy, round(coalesce(hn.h, 0), 6) + 0.0 AS node_label_entropy, round(coalesce(he.h, 0), 6) + 0.0 AS edge_label_entropy FROM hd LEFT JOIN hn ON hn.graph_id = hd.graph_id LEFT JOIN he ON he.graph_id = hd.graph_id""")  # fmt: skip
def graph_entropies(spark, d):
    nodes, edges = _graph(spark, d)
    out = rounded(G.entropies(nodes, G.simple_edges(edges)))
    return out.withColumns({c: F.col(c) + 0.0 for c in out.columns if c != "graph_id"})


@query("graph_clustering", f"""
WITH {_GRAPH}, b AS (SELECT graph_id, u AS a, v AS b FROM s UNION ALL SELECT graph_id, v, u FROM s), k AS (SELECT graph_id, a, count(*) AS d FROM b GROUP BY 1, 2),
t AS (SELECT x.graph_id, x.a, count(*) AS t FROM b x JOIN b y ON x.graph_id = y.graph_id AND x.a = y.a AND x.b < y.b JOIN s ON s.graph_id = x.graph_id AND s.u = x.b AND s.v = y.b GROUP BY 1, 2),
cc AS (SELECT k.graph_id, CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS cc FROM k LEFT JOIN t ON t.graph_id = k.graph_id AND t.a = k.a), z AS (SELECT graph_id, sum(cc) AS z FROM cc GROUP BY 1)
SELECT q.graph_id, round(coalesce(z, 0) / q.n, 6) AS avg_clustering FROM (SELECT graph_id, count(DISTINCT id) AS n FROM n GROUP BY 1) q LEFT JOIN z ON z.graph_id = q.graph_id""")  # fmt: skip
def graph_clustering(spark, d):
    nodes, edges = _graph(spark, d)
    return rounded(G.clustering(nodes, G.simple_edges(edges)))


@query("graph_metrics")
def graph_metrics(spark, d):
    return G.metrics(*_graph(spark, d))


@query("graph_summary")
def graph_summary(spark, d):
    return G.summary(graph_metrics(spark, d))


@query("graph_validity", """
SELECT 'g' || c_custkey AS graph_id, c_custkey % 5 > 0 AND c_custkey % 7 > 0 AS valid, CASE WHEN c_custkey % 5 = 0 THEN 'no label' WHEN c_custkey % 7 = 0 THEN 'edge to unknown node' END AS reason FROM customer""")  # fmt: skip
def graph_validity(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("graph_id"), "c_custkey", "c_mktsegment")
    graphs = c.select("graph_id", F.when(F.col("c_custkey") % 5 == 0, " ").otherwise("x").alias("graph_label"), F.lit("a").alias("center_id"))
    nodes = c.select("graph_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("id"), F.col("c_mktsegment").alias("label"))
    edges = c.select("graph_id", F.lit("a").alias("source"), F.when(F.col("c_custkey") % 7 == 0, "z").otherwise("b").alias("target"))
    return G.validity(nodes, edges, graphs)


@query("pooled_ego_features", f"""
WITH {_EGO}, f AS (SELECT id, [CAST(length(text) AS DOUBLE), CAST(ascii(label) AS DOUBLE)] AS f FROM c)
SELECT e.graph_id, [round(sum(weight * f[1]) / sum(weight), 6), round(sum(weight * f[2]) / sum(weight), 6)] AS features FROM e JOIN f ON f.id = e.target WHERE e.source = e.graph_id GROUP BY 1""")  # fmt: skip
def pooled_ego_features(spark, d):
    c = _clauses(spark, d)
    f = c.select("id", F.array(F.length("text").cast("double"), F.ascii("label").cast("double")).alias("features"))
    out = G.pooled(G.ego_edges(c), f, 2)
    return out.select("graph_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query("remapped_edges", f"WITH {_GRAPH}, i AS (SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS i FROM n) SELECT e.graph_id, CAST(a.i AS INTEGER) AS source_index, CAST(b.i AS INTEGER) AS target_index FROM e JOIN i a ON a.graph_id = e.graph_id AND a.id = e.source JOIN i b ON b.graph_id = e.graph_id AND b.id = e.target")
def remapped_edges(spark, d):
    return G.remapped(*_graph(spark, d))


@query("one_hot_roles", "SELECT conv_id, turn, [CAST(role = 'assistant' AS DOUBLE), CAST(role = 'system' AS DOUBLE), CAST(role = 'user' AS DOUBLE)] AS features FROM conversations")
def one_hot_roles(spark, d):
    return G.one_hot_pos(table(spark, d, "conversations").select("conv_id", "turn", "role"), "role").select("conv_id", "turn", F.transform("features", lambda x: x).alias("features"))


_TAGS = "CASE WHEN l_linenumber = 1 THEN 'B-V' WHEN l_linenumber IN (2, 5) THEN 'B-ARG0' WHEN l_linenumber IN (3, 6) THEN 'I-ARG0' ELSE 'O' END"


def _spans(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sentence"), F.lit(0).alias("predicate"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("token"), F.expr(_TAGS).alias("tag"))
    return G.bio_spans(rows.dropDuplicates(["sentence", "pos"]))


_SPANS = f"""
t AS (SELECT DISTINCT l_orderkey AS sentence, 0 AS predicate, l_linenumber AS pos, 'w' || l_linenumber AS token, {_TAGS} AS tag FROM lineitem),
r AS (SELECT *, regexp_replace(tag, '^[BI]-', '') AS role, regexp_replace(coalesce(lag(tag) OVER w, 'O'), '^[BI]-', '') AS before FROM t WINDOW w AS (PARTITION BY sentence ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' OR before = 'O' OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY sentence ORDER BY pos) AS run FROM r),
spans AS (SELECT sentence, predicate, role, min(pos) AS start, max(pos) + 1 AS "end", string_agg(token, ' ' ORDER BY pos) AS text FROM g WHERE tag <> 'O' GROUP BY sentence, predicate, run, role)"""


@query("role_spans", f"WITH {_SPANS} SELECT * FROM spans")
def role_spans(spark, d):
    return _spans(spark, d)


@query("role_graphs", f"WITH {_SPANS} SELECT v.sentence || '_' || v.predicate AS graph_id, v.text AS source, s.text AS target, s.role AS label FROM spans v JOIN spans s ON v.sentence = s.sentence AND v.predicate = s.predicate WHERE v.role = 'V' AND s.role <> 'V'")
def role_graphs(spark, d):
    return G.role_edges(_spans(spark, d))


@query("weighted_role_graphs", "SELECT CAST(o_orderkey AS VARCHAR) AS graph_id, CAST(o_orderkey AS VARCHAR) AS source, o_orderpriority AS target, 'role' AS label, o_totalprice AS weight FROM orders")
def weighted_role_graphs(spark, d):
    return G.weighted_role_edges(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("role"), F.col("o_totalprice").alias("score")))


def _triples(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("graph_id"), "*")
    inst = c.select("graph_id", F.lit("x").alias("source"), F.lit(":instance").alias("role"), F.concat(F.lower("c_mktsegment"), F.lit("-01")).alias("target"))
    rest = c.select("graph_id", F.lit("x").alias("source"), F.lit(":quant").alias("role"), F.col("c_nationkey").cast("string").alias("target"))
    return G.triples_to_graph(inst.unionByName(rest))


@query("meaning_nodes", "SELECT 'g' || c_custkey AS graph_id, 'x' AS id, lower(c_mktsegment) AS label FROM customer UNION ALL SELECT 'g' || c_custkey, 'Num:' || c_nationkey, 'Num:' || c_nationkey FROM customer")
def meaning_nodes(spark, d):
    return _triples(spark, d)[0]


@query("meaning_edges", "SELECT 'g' || c_custkey AS graph_id, 'x' AS source, 'Num:' || c_nationkey AS target, 'quant' AS label FROM customer")
def meaning_edges(spark, d):
    return _triples(spark, d)[1]


@query("dependency_graphs", "SELECT l_orderkey AS graph_id, '1' AS source, CAST(l_linenumber AS VARCHAR) AS target, l_returnflag AS label FROM lineitem WHERE l_linenumber > 1")
def dependency_graphs(spark, d):
    """Line items as tokens whose head is their order's first."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("i"), F.lit("w").alias("text"), F.col("l_linestatus").alias("pos"), F.col("l_returnflag").alias("dep"), F.lit(1).alias("head"))
    return G.dependency_graphs(rows)[1]


@query("propagated_features", f"""
WITH {_GRAPH}, x AS (SELECT graph_id, id, CAST(ascii(label) AS DOUBLE) AS f FROM n), l AS (SELECT graph_id, source, target FROM e UNION ALL SELECT graph_id, id, id FROM n)
SELECT l.graph_id, l.target AS id, [round(avg(f), 6)] AS features FROM l JOIN x ON x.graph_id = l.graph_id AND x.id = l.source GROUP BY 1, 2""")  # fmt: skip
def propagated_features(spark, d):
    nodes, edges = _graph(spark, d)
    out = G.propagated(nodes.select("graph_id", "id", F.array(F.ascii("label").cast("double")).alias("features")), edges, 1, 1)
    return out.select("graph_id", "id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))
