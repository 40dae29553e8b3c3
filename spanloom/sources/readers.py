"""Readers of the corpus's file shapes; all go through Spark's own sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Names under which container files keep their records.
CONTAINERS = ("data", "records", "rows", "items")
SPLITS = ("train", "dev", "validation", "test")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON list of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_dict(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Files that each hold one JSON object of records by id: columns id and those of ``record`` (a struct's fields)."""
    text = spark.read.text(path, wholetext=True)
    flat = text.select(F.explode(F.from_json("value", f"map<string,struct<{record}>>")).alias("id", "r"))
    return flat.select("id", "r.*")


def jsonl(spark: SparkSession, path: str, schema: str, number: str | None = None) -> DataFrame:
    """One record a line; lines that aren't JSON are left out. ``number`` names a column for the record's place, from 0.

    Places count lines within each partition first and add what lies ahead, so
    that no task sees the whole file.
    """
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    if number is None:
        return rows.where("_bad IS NULL").drop("_bad")
    placed = rows.withColumns({"__id": F.monotonically_increasing_id()}).withColumn("__part", F.shiftright("__id", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__c"))
    ahead = counts.select("__part", F.coalesce(F.sum("__c").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    place = F.col("__ahead") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(ahead), "__part").withColumn(number, place).where("_bad IS NULL").drop("_bad", "__id", "__part", "__ahead")  # a row for each partition


def sniffed(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A file of records by id, or of one record with its id a line: told by its first record's shape."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    line = head[0][0].strip() if head else ""
    if line.startswith("{") and not line.endswith("}") or line.startswith("{") and '"id"' not in line.split(":")[0]:
        return json_dict(spark, path, record)
    return jsonl(spark, path, f"id string, {record.replace(':', ' ')}")


def container(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A list, an object with a list under a known name, splits, records by id, or lines: records with their split, if any."""
    text = spark.read.text(path, wholetext=True).select("value")
    array = f"array<struct<{record}>>"
    parts = []
    listed = text.where(F.trim("value").startswith("["))
    parts.append(listed.select(F.lit(None).cast("string").alias("split"), F.explode(F.from_json("value", array)).alias("r")))
    objects = text.where(F.trim("value").startswith("{"))
    keys = F.json_object_keys("value")
    for name in (*CONTAINERS, *SPLITS):
        own = objects.where(F.array_contains(keys, name))
        split = F.lit(name if name in SPLITS else None).cast("string")
        parts.append(own.select(split.alias("split"), F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), array)).alias("r")))
    known = F.arrays_overlap(keys, F.array(*[F.lit(x) for x in (*CONTAINERS, *SPLITS)]))
    other = objects.where(keys.isNotNull() & ~known)
    parts.append(other.select(F.lit(None).cast("string").alias("split"), F.explode(F.map_values(F.from_json("value", f"map<string,struct<{record}>>"))).alias("r")))
    lines = objects.where(keys.isNull()).select(F.explode(F.split("value", "\n")).alias("v")).where(F.trim("v") != "")
    parts.append(lines.select(F.lit(None).cast("string").alias("split"), F.from_json("v", f"struct<{record}>").alias("r")).where("r IS NOT NULL"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("split", "r.*")


def merged(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Records of all parts by key; a later part's record replaces an earlier one's."""
    columns = parts[0].columns
    out = None
    for i, p in enumerate(parts):
        tagged = p.select(*columns).withColumn("__src", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    best = out.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), "__src").alias("r"))
    return best.select(key, "r.*").select(*columns)


def graph_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of one graph a file, named by the file or its ``graph_id`` folder, with edges under ``edges`` or ``links`` and ends under either naming."""
    node = "struct<id:string,label:string,pos:string,type:string>"
    edge = "struct<source:string,target:string,`from`:string,`to`:string,label:string,dep:string,weight:double>"
    schema = f"nodes array<{node}>, edges array<{edge}>, links array<{edge}>, label string, center_id string, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path, multiLine=True)
    place = F.col("_metadata.file_path")
    folder = F.nullif(F.regexp_extract(place, "/graph_id=([^/]+)/", 1), F.lit(""))
    name = F.regexp_replace(F.element_at(F.split(place, "/"), -1), r"\.json$", "")
    rows = rows.withColumn("graph_id", F.url_decode(F.coalesce(folder, name)))
    good = rows.where("_bad IS NULL AND nodes IS NOT NULL")
    nodes = good.select("graph_id", F.posexplode("nodes").alias("p", "n")).select("graph_id", F.coalesce("n.id", F.concat(F.lit("node_"), F.col("p"))).alias("id"), "n.label", "n.pos", "n.type")
    e = good.select("graph_id", F.explode(F.coalesce("edges", "links")).alias("e"))
    edges = e.select("graph_id", F.coalesce("e.source", "e.from").alias("source"), F.coalesce("e.target", "e.to").alias("target"), F.coalesce("e.label", "e.dep").alias("label"), "e.dep", F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return nodes, edges, rows.where("_bad IS NOT NULL OR nodes IS NULL").select("graph_id", F.coalesce("_bad", F.lit("no nodes")).alias("error"))


def csv_with_method(spark: SparkSession, path: str, schema: str, pattern: str = r"([a-z]+)_(code|subcode|combined)", methods: Sequence[str] = ("jaccard", "tfidf", "lsa", "sbert")) -> DataFrame:
    """CSV files with ``method`` and ``level`` from their names; where the pattern fails, a known method's name anywhere in it."""
    rows = spark.read.schema(schema).csv(path, header=True)
    name = F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    token = F.coalesce(*[F.when(F.contains(name, F.lit(m)), F.lit(m)) for m in methods])
    method, level = F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))
    return rows.select("*", F.coalesce(method, token).alias("method"), level.alias("level"))


def lenient_csv(spark: SparkSession, path: str, numbers: dict[str, str]) -> DataFrame:
    """CSV as text, with the named columns cast where they can be and null where not."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in numbers.items() if c in rows.columns})


def codebook_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A codebook's sheet with its rows numbered: CSV, or Excel where a reader for it is installed (a sheet is small)."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
        rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None))
        return rows.withColumn("row", F.monotonically_increasing_id())
    return spark.read.csv(path, header=True, multiLine=True).withColumn("row", F.monotonically_increasing_id())


def coded(rows: DataFrame, column: str, names: dict[int, str]) -> DataFrame:
    """Codes of a public data set replaced by their names; unknown ones are null."""
    return rows.withColumn(column, F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(column)])


def topics(spark: SparkSession, path: str) -> DataFrame:
    """topic, words from a long table (topic or topic_id, word) or a wide one (a topic a row)."""
    rows = spark.read.csv(path, header=True)
    lower = {c.lower(): c for c in rows.columns}
    name = lower.get("topic") or lower.get("topic_id")
    if name and "word" in lower:
        return rows.where(F.trim(lower["word"]) != "").groupBy(F.col(name).alias("topic")).agg(F.array_sort(F.collect_list(F.trim(lower["word"]))).alias("words"))
    words = F.filter(F.array(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns if c != name]), lambda w: w != "")
    topic = F.col(name) if name else F.concat(F.lit("topic_"), F.monotonically_increasing_id())
    return rows.select(topic.alias("topic"), words.alias("words"))


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """Feature sets, kept as Parquet of arrays: id, features, y."""
    return spark.read.parquet(path)
