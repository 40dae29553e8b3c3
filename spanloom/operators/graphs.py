"""Clause graphs: construction, validity, structure and features."""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.numbers import entropy_bits
from spanloom.functions.text import has_cue

#: Fixed weights of the relations.
WEIGHTS = {"self": 1.0, "next": 0.8, "prev": 0.8, "same_label": 0.7, "elaboration": 0.6, "contrast": 0.5}
METRICS = ("n_nodes", "n_edges", "density", "avg_degree", "diameter", "aspl", "avg_clustering", "degree_entropy", "node_label_entropy", "edge_label_entropy", "unique_eigenvalues", "spectral_entropy", "energy")
WL_ROUNDS = 3


def next_edges(clauses: DataFrame, message: str, key: str) -> DataFrame:
    w = W.partitionBy(message).orderBy(key)
    return clauses.select(F.col(message).alias("graph_id"), F.col(key).alias("source"), F.lead(key).over(w).alias("target")).where("target IS NOT NULL").withColumn("label", F.lit("next"))


def ego_edges(clauses: DataFrame, message: str = "message", key: str = "id", label: str = "label", text: str = "text") -> DataFrame:
    """Edges of the graph around each clause: itself, its neighbours, clauses of the same label, cues to the next clause.

    ``prev`` points at the centre, the rest away from it. Graphs stay within a
    message, whose clauses are few by nature.
    """
    rows = clauses.select(F.col(message).alias("m"), F.col(key).alias("id"), F.col(label).alias("code"), F.col(text).alias("t")).withColumns({"nx": F.lead("id").over(W.partitionBy("m").orderBy("id")), "pv": F.lag("id").over(W.partitionBy("m").orderBy("id"))})

    def edge(name: str, source: str, target: str, when: Column | None = None) -> Column:
        made = F.struct(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(name).alias("label"), F.lit(WEIGHTS[name]).alias("weight"))
        return made if when is None else F.when(when, made)

    has_next, has_prev = F.col("nx").isNotNull(), F.col("pv").isNotNull()
    own = F.array_compact(F.array(
        edge("self", "id", "id"), edge("next", "id", "nx", has_next), edge("prev", "pv", "id", has_prev),
        edge("elaboration", "id", "nx", has_next & has_cue(F.col("t"), "elaboration")), edge("contrast", "id", "nx", has_next & has_cue(F.col("t"), "contrast")),
    ))
    near = rows.select(F.col("id").alias("graph_id"), F.explode(own).alias("e")).select("graph_id", "e.*")
    a = rows.select("m", "code", F.col("id").alias("graph_id"))
    b = rows.select("m", "code", F.col("id").alias("target"))
    same = a.join(b, ["m", "code"]).where("graph_id <> target").select("graph_id", F.col("graph_id").alias("source"), "target", F.lit("same_label").alias("label"), F.lit(WEIGHTS["same_label"]).alias("weight"))
    return near.unionByName(same)


def ego_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct()


def message_ego_edges(clauses: DataFrame, message: str = "message", key: str = "id", text: str = "text", cues_to_all: bool = False) -> DataFrame:
    """The older ego graph: ``next`` edges that touch the centre, and, if asked, its cues to every other clause."""
    steps = next_edges(clauses, message, key)
    touching = steps.select(F.explode(F.array("source", "target")).alias("graph_id"), "source", "target", "label")
    out = touching.withColumn("weight", F.lit(WEIGHTS["next"]))
    if not cues_to_all:
        return out
    a = clauses.select(F.col(message).alias("m"), F.col(key).alias("graph_id"), F.col(text).alias("t"))
    b = clauses.select(F.col(message).alias("m"), F.col(key).alias("target"))
    both = a.join(b, "m").where("graph_id <> target")
    for kind in ("elaboration", "contrast"):
        out = out.unionByName(both.where(has_cue(F.col("t"), kind)).select("graph_id", F.col("graph_id").alias("source"), "target", F.lit(kind).alias("label"), F.lit(WEIGHTS[kind]).alias("weight")))
    return out


def bio_spans(tags: DataFrame) -> DataFrame:
    """(sentence, predicate, role, start, end, text) from (sentence, predicate, pos, token, tag); a role open at the end is kept."""
    w = W.partitionBy("sentence", "predicate").orderBy("pos")
    role = F.regexp_replace("tag", "^[BI]-", "")
    new = F.col("tag").startswith("B-") | (F.coalesce(F.lag("tag").over(w), F.lit("O")) == "O") | (F.regexp_replace(F.coalesce(F.lag("tag").over(w), F.lit("O")), "^[BI]-", "") != role)
    rows = tags.withColumn("role", role).withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("tag <> 'O'")
    out = rows.groupBy("sentence", "predicate", "run", "role").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return out.select("sentence", "predicate", "role", "start", "end", F.array_join("x.token", " ").alias("text"))


def role_edges(spans: DataFrame) -> DataFrame:
    """Edges from each predicate's verb span to its other roles."""
    verb = spans.where("role = 'V'").select("sentence", "predicate", F.col("text").alias("source"))
    return verb.join(spans.where("role <> 'V'"), ["sentence", "predicate"]).select(F.concat_ws("_", F.col("sentence").cast("string"), F.col("predicate").cast("string")).alias("graph_id"), "source", F.col("text").alias("target"), F.col("role").alias("label"))


def weighted_role_edges(scores: DataFrame) -> DataFrame:
    """Edges from each text to its roles, weighted by their score."""
    return scores.select(F.col("id").alias("graph_id"), F.col("id").alias("source"), F.col("role").alias("target"), F.lit("role").alias("label"), F.col("score").cast("double").alias("weight"))


def triples_to_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of meaning triples (graph_id, source, role, target): instances are nodes, plain values get nodes of their own."""
    clean = F.regexp_replace(F.col("target"), r"-\d\d$", "")
    nodes = triples.where("role IN (':instance', 'instance')").select("graph_id", F.col("source").alias("id"), clean.alias("label"))
    rest = triples.where("role NOT IN (':instance', 'instance')")
    known = nodes.select("graph_id", F.col("id").alias("target"), F.lit(True).alias("known"))
    rest = rest.join(known, ["graph_id", "target"], "left")
    number = F.rlike("target", F.lit(r"^-?\d+(\.\d+)?$"))
    value = F.when(number, F.concat(F.lit("Num:"), F.col("target"))).otherwise(F.regexp_replace("target", '^"|"$', ""))
    rest = rest.withColumn("node", F.when(F.col("known"), F.col("target")).otherwise(value))
    extra = rest.where("known IS NULL").select("graph_id", F.col("node").alias("id"), F.col("node").alias("label")).distinct()
    return nodes.unionByName(extra), rest.select("graph_id", "source", F.col("node").alias("target"), F.regexp_replace("role", "^:", "").alias("label"))


def validity(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, valid, reason: the first check that fails.

    Checks: a label, a centre among the nodes if one is named, nodes, labels that
    aren't blank, edges between known nodes.
    """
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.sum((F.trim(F.coalesce("label", F.lit(""))) == "").cast("int")).alias("blank"), F.collect_set("id").alias("ids"))
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("id")).where("id IS NOT NULL").distinct()
    loose = ends.join(nodes.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_anti").groupBy("graph_id").agg(F.count("*").alias("loose"))
    rows = graphs.join(n, "graph_id", "left").join(loose, "graph_id", "left")
    reason = (
        F.when(F.trim(F.coalesce("graph_label", F.lit(""))) == "", "no label").when(F.coalesce("n", F.lit(0)) == 0, "no nodes").when(F.col("blank") > 0, "blank node label")
        .when(F.col("center_id").isNotNull() & ~F.array_contains("ids", F.col("center_id")), "center missing").when(F.coalesce("loose", F.lit(0)) > 0, "edge to unknown node")
    )
    return rows.select("graph_id", reason.isNull().alias("valid"), reason.alias("reason"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected, without loops and parallels; a pair's label is its smallest."""
    u, v = F.least("source", "target"), F.greatest("source", "target")
    return edges.where("source <> target").groupBy("graph_id", u.alias("u"), v.alias("v")).agg(F.min("label").alias("label"))


def sizes(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density and average degree of each graph."""
    n = nodes.groupBy("graph_id").agg(F.countDistinct("id").alias("n_nodes"))
    m = simple.groupBy("graph_id").agg(F.count("*").alias("m"))
    out = n.join(m, "graph_id", "left").withColumn("n_edges", F.coalesce("m", F.lit(0))).drop("m")
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return out.withColumns({"density": F.when(pairs > 0, 2 * F.col("n_edges") / pairs).otherwise(0.0), "avg_degree": F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0)})


def entropies(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Entropies, in bits, of each graph's degrees, node labels and edge labels."""
    ends = simple.select("graph_id", F.explode(F.array("u", "v")).alias("id")).groupBy("graph_id", "id").agg(F.count("*").alias("d"))
    degrees = nodes.select("graph_id", "id").distinct().join(ends, ["graph_id", "id"], "left").select("graph_id", F.coalesce("d", F.lit(0)).cast("string").alias("x"))

    def of(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("graph_id", "x").agg(F.count("*").alias("c"))
        return counts.groupBy("graph_id").agg(entropy_bits(F.array_sort(F.collect_list("c"))).alias(name))

    labels = of(nodes.select("graph_id", F.coalesce("label", F.lit("")).alias("x")), "node_label_entropy")
    edge_labels = of(simple.select("graph_id", F.coalesce("label", F.lit("")).alias("x")), "edge_label_entropy")
    out = of(degrees, "degree_entropy").join(labels, "graph_id", "left").join(edge_labels, "graph_id", "left")
    return out.na.fill(0.0)


def clustering(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Average clustering coefficient: closed triples of each node's neighbours, found by joins on edges."""
    both = simple.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b")).unionByName(simple.select("graph_id", F.col("v").alias("a"), F.col("u").alias("b")))
    degree = both.groupBy("graph_id", "a").agg(F.count("*").alias("d"))
    x, y = both.select("graph_id", "a", "b"), both.select("graph_id", "a", F.col("b").alias("c"))
    closed = simple.select("graph_id", F.col("u").alias("b"), F.col("v").alias("c"))
    triangles = x.join(y, ["graph_id", "a"]).where("b < c").join(closed, ["graph_id", "b", "c"]).groupBy("graph_id", "a").agg(F.count("*").alias("t"))
    local = degree.join(triangles, ["graph_id", "a"], "left").withColumn("cc", F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0))
    n = nodes.groupBy("graph_id").agg(F.countDistinct("id").alias("n"))
    s = local.groupBy("graph_id").agg(F.sum("cc").alias("s"))
    return n.join(s, "graph_id", "left").select("graph_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("avg_clustering"))


def _distances(adjacent: dict, start) -> dict:
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in adjacent[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


def wl_hash(labels: dict, adjacent: dict, rounds: int = WL_ROUNDS) -> str:
    """Equal for graphs that colour refinement can't tell apart."""
    digest = lambda s: hashlib.blake2b(s.encode(), digest_size=8).hexdigest()
    colours, counts = {k: digest(str(v)) for k, v in labels.items()}, []
    for _ in range(rounds):
        colours = {k: digest(colours[k] + "".join(sorted(colours[x] for x in adjacent[k]))) for k in colours}
        counts += sorted(colours.values())
    return digest(" ".join(counts or sorted(colours.values())))


def structure(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Per graph: diameter and mean path length of the largest component, eigenvalue measures, colour-refinement hash.

    A graph is one clause or message and fits a task.
    """
    n = nodes.select("graph_id", F.col("id").cast("string").alias("u"), F.lit(None).cast("string").alias("v"), F.coalesce("label", F.lit("")).alias("label"))
    e = simple.select("graph_id", F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.coalesce("label", F.lit("")).alias("label"))

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["v"].isna()].drop_duplicates("u").sort_values("u")
        labels = dict(zip(own["u"], own["label"]))
        adjacent = {k: set() for k in labels}
        for u, v in pdf.loc[pdf["v"].notna(), ["u", "v"]].itertuples(index=False):
            if u in adjacent and v in adjacent:
                adjacent[u].add(v)
                adjacent[v].add(u)
        left, largest = set(labels), []
        while left:
            part = sorted(_distances(adjacent, min(left)))
            left -= set(part)
            largest = max(largest, part, key=len)
        far = [d for x in largest for d in _distances(adjacent, x).values() if d]
        place = {k: i for i, k in enumerate(labels)}
        a = np.zeros((len(place), len(place)))
        for x, ys in adjacent.items():
            for y in ys:
                a[place[x], place[y]] = 1.0
        laplacian = np.linalg.eigvalsh(np.diag(a.sum(1)) - a) if len(a) else np.zeros(0)
        share = laplacian[laplacian > 1e-12] / laplacian.sum() if laplacian.sum() > 1e-12 else np.zeros(0)
        energy = float(np.abs(np.linalg.eigvalsh(a)).sum()) if len(a) else 0.0
        spectral = float(-(share * np.log2(share)).sum()) if len(share) else 0.0
        row = (pdf["graph_id"].iloc[0], max(far, default=0), float(np.mean(far)) if far else 0.0, len(set(np.round(laplacian, 8) + 0.0)), spectral, energy, wl_hash(labels, adjacent))
        return pd.DataFrame([row], columns=["graph_id", "diameter", "aspl", "unique_eigenvalues", "spectral_entropy", "energy", "wl_hash"])

    return n.unionByName(e).groupBy("graph_id").applyInPandas(measure, "graph_id string, diameter int, aspl double, unique_eigenvalues int, spectral_entropy double, energy double, wl_hash string")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All measures of each graph."""
    nodes = nodes.withColumn("graph_id", F.col("graph_id").cast("string"))
    simple = simple_edges(edges.withColumn("graph_id", F.col("graph_id").cast("string")))
    out = sizes(nodes, simple)
    for part in (structure(nodes, simple), clustering(nodes, simple), entropies(nodes, simple)):
        out = out.join(part, "graph_id")
    return out


def summary(rows: DataFrame) -> DataFrame:
    """metric, mean, std over graphs (0 for one), distinct hashes and their share."""
    stats = [F.struct(F.lit(m).alias("metric"), F.avg(F.col(m).cast("double")).alias("mean"), F.coalesce(F.stddev_samp(F.col(m).cast("double")), F.lit(0.0)).alias("std")) for m in METRICS]
    one = rows.agg(F.array(*stats).alias("x"), F.countDistinct("wl_hash").alias("n_hashes"), F.count("*").alias("n_graphs"))
    return one.select(F.explode("x").alias("x"), "n_hashes", "n_graphs").select("x.*", "n_hashes", (F.col("n_hashes") / F.col("n_graphs")).alias("distinguishability"))


def pooled(edges: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """graph_id and the weighted mean of the vectors that the centre points to, itself included."""
    out = edges.where("source = graph_id").select("graph_id", F.col("target").alias("id"), "weight").join(features, "id")
    sums = out.groupBy("graph_id").agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.get("features", i)).alias(f"s{i}") for i in range(dim)])
    return sums.select("graph_id", F.array(*[F.col(f"s{i}") / F.col("w") for i in range(dim)]).alias("features"))


def remapped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by 0-based places of their nodes in each graph; dangling ones are dropped."""
    place = nodes.select("graph_id", "id").distinct().withColumn("i", F.row_number().over(W.partitionBy("graph_id").orderBy("id")) - 1)
    a = place.select("graph_id", F.col("id").alias("source"), F.col("i").alias("source_index"))
    b = place.select("graph_id", F.col("id").alias("target"), F.col("i").alias("target_index"))
    return edges.join(a, ["graph_id", "source"]).join(b, ["graph_id", "target"]).select("graph_id", "source_index", "target_index")


def one_hot_pos(nodes: DataFrame, pos: str = "pos") -> DataFrame:
    """Nodes with a vector that marks their tag among all tags found, by name; tag sets are small."""
    tags = [r[0] for r in nodes.select(pos).where(F.col(pos).isNotNull()).distinct().orderBy(pos).collect()]
    return nodes.withColumn("features", F.array(*[(F.coalesce(F.col(pos), F.lit("")) == t).cast("double") for t in tags]))


def dependency_graphs(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed sentences (graph_id, i, text, pos, dep, head): an edge from each head to its dependent, none for roots."""
    nodes = tokens.select("graph_id", F.col("i").cast("string").alias("id"), F.col("text").alias("label"), "pos")
    edges = tokens.where("head IS NOT NULL AND head <> i").select("graph_id", F.col("head").cast("string").alias("source"), F.col("i").cast("string").alias("target"), F.col("dep").alias("label"))
    return nodes, edges


def propagated(nodes: DataFrame, edges: DataFrame, dim: int, rounds: int = 2) -> DataFrame:
    """Node features (graph_id, id, features) after rounds of weighted means over each node and its in-neighbours: the linear part of a graph network."""
    both = edges.select("graph_id", "source", "target", F.coalesce(F.col("weight"), F.lit(1.0)).alias("weight") if "weight" in edges.columns else F.lit(1.0).alias("weight"))
    own = nodes.select("graph_id", F.col("id").alias("source"), F.col("id").alias("target"), F.lit(1.0).alias("weight"))
    links = both.unionByName(own)
    x = nodes.select("graph_id", "id", "features")
    for _ in range(rounds):
        joined = links.join(x.withColumnRenamed("id", "source"), ["graph_id", "source"])
        sums = joined.groupBy("graph_id", F.col("target").alias("id")).agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.get("features", i)).alias(f"s{i}") for i in range(dim)])
        x = sums.select("graph_id", "id", F.array(*[F.col(f"s{i}") / F.col("w") for i in range(dim)]).alias("features"))
    return x
