"""The codebook as a tree: parsing, paths, subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.text import codebook_id
from spanloom.session import written

#: Levels of recursion that SQL may take; codebooks are a few levels deep.
MOST_LEVELS = 1000


def fill_down(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Each column's last value that isn't null, from the top; a sheet is small and its order is one sequence."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def parse_sheet(sheet: DataFrame, order: str = "row") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from a sheet whose codes and subcodes stand only in their first row.

    Numbered entries in the subcode's definition, ``1. Name: text``, are subsubcodes. Of nodes of
    one id the first stays.
    """
    rows = fill_down(sheet.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in ("CODE", "SUB-CODE")}), ["CODE"], order)
    sub_w = W.partitionBy("CODE").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("SUB-CODE", F.last("SUB-CODE", ignorenulls=True).over(sub_w))
    code, sub = codebook_id(F.col("CODE")), codebook_id(F.col("SUB-CODE"))
    names = F.regexp_extract_all("SUB-CODE DEFINITION", F.lit(r"(?:^|\n)\s*\d+\.\s*([^:\n]+)"), F.lit(1))
    flat = rows.select(order, code.alias("code"), sub.alias("sub"), F.col("CODE DEFINITION").alias("code_text"), F.col("SUB-CODE DEFINITION").alias("sub_text"), F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    leaf = flat.select(order, "sub", F.posexplode("names").alias("p", "name")).select(order, "p", F.col("sub").alias("source"), codebook_id(F.col("name")).alias("id"), F.col("name").alias("text"))
    parts = [
        flat.select(order, F.lit(-2).alias("p"), F.col("code").alias("id"), F.lit("code").alias("type"), F.col("code_text").alias("text")),
        flat.select(order, F.lit(-1).alias("p"), F.col("sub").alias("id"), F.lit("subcode").alias("type"), F.col("sub_text").alias("text")),
        leaf.select(order, "p", "id", F.lit("subsubcode").alias("type"), "text"),
    ]
    nodes = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("id IS NOT NULL")
    nodes = nodes.groupBy("id").agg(F.min(F.struct(order, "p", "type", "text")).alias("m")).select("id", "m.type", F.array_compact(F.array("m.text")).alias("description"))
    edges = flat.select(F.col("code").alias("source"), F.col("sub").alias("target")).unionByName(leaf.select("source", F.col("id").alias("target")))
    return nodes, edges.where("source IS NOT NULL AND target IS NOT NULL").distinct()


def number_children(edges: DataFrame) -> DataFrame:
    """1-based numbers of the children of each parent, by id."""
    return edges.withColumn("number", F.row_number().over(W.partitionBy("source").orderBy("target")))


def path_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, index (``1_2_3``), depth of every node on a path from a root; a node met again on its own path ends it."""
    spark = nodes.sparkSession
    return spark.sql(
        f"""
        WITH RECURSIVE numbered AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM {{edges}}),
        roots AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM {{nodes}} WHERE id NOT IN (SELECT target FROM {{edges}} WHERE target IS NOT NULL)),
        walk(id, idx, depth, path) MAX RECURSION LEVEL {MOST_LEVELS} AS (
          SELECT id, CAST(n AS STRING), 1, array(id) FROM roots
          UNION ALL
          SELECT e.target, concat(w.idx, '_', CAST(e.n AS STRING)), w.depth + 1, array_append(w.path, e.target)
          FROM walk w JOIN numbered e ON e.source = w.id WHERE NOT array_contains(w.path, e.target))
        SELECT w.id, n.type, w.idx AS index, w.depth FROM walk w LEFT JOIN {{nodes}} n ON n.id = w.id""",
        nodes=nodes, edges=edges,
    )


def subtree(nodes: DataFrame, edges: DataFrame, keyword: str, order: str = "ord") -> DataFrame:
    """Ids below the first node, by ``order``, whose lower-case id contains the keyword, itself included; ``all_node`` is everything."""
    spark = nodes.sparkSession
    if keyword == "all_node":
        return nodes.select("id")
    seed = nodes.where(F.contains(F.lower("id"), F.lit(keyword.lower()))).agg(F.min_by("id", order).alias("id")).where("id IS NOT NULL")
    return spark.sql(
        f"""
        WITH RECURSIVE walk(id, path) MAX RECURSION LEVEL {MOST_LEVELS} AS (
          SELECT id, array(id) FROM {{seed}}
          UNION ALL
          SELECT e.target, array_append(w.path, e.target) FROM walk w JOIN {{edges}} e ON e.source = w.id WHERE NOT array_contains(w.path, e.target))
        SELECT DISTINCT id FROM walk""",
        seed=seed, edges=edges,
    )


def subtrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id) for every node and everything below it, itself included.

    Level by level, each written to the shared folder, until one brings nothing new: recursion in SQL ends with an
    error beyond a million rows.
    """
    found = ahead = written(nodes.select(F.col("id").alias("root"), "id").distinct(), "subtrees")
    below = edges.where("target IS NOT NULL").select(F.col("source").alias("id"), "target")
    while not ahead.isEmpty():
        new = ahead.join(below, "id").select("root", F.col("target").alias("id")).distinct()
        ahead = written(new.join(found, ["root", "id"], "left_anti"), "subtrees")
        found = found.unionByName(ahead)
    return found


def message_tree(segmented: DataFrame) -> DataFrame:
    """(source, target) from messages to sentences to subsentences."""
    s = segmented.select(F.col("message_id").cast("string").alias("m"), F.explode("sentences").alias("s"))
    sub = s.select(F.col("s.sentence_id").alias("source"), F.explode("s.subsentences.subsentence_id").alias("target"))
    return s.select(F.col("m").alias("source"), F.col("s.sentence_id").alias("target")).unionByName(sub)
