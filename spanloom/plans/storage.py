"""Queries: sources, sinks and streams, each written and read again in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.operators import hierarchy as H
from spanloom.plans.registry import query, table
from spanloom.session import shared_path
from spanloom.sources import readers as R
from spanloom.sources import writers as K
from spanloom.streaming import labels as S


@query("json_lines_source", "SELECT conv_id, turn, role FROM conversations")
def json_lines_source(spark, d):
    path = shared_path(spark, "jsonl")
    table(spark, d, "conversations").select("conv_id", "turn", "role").write.json(path)
    return R.jsonl(spark, path, "conv_id long, turn long, role string")


@query("numbered_lines_source", "SELECT n_nationkey, n_name, CAST(n_nationkey AS BIGINT) AS message_id FROM nation")
def numbered_lines_source(spark, d):
    path = shared_path(spark, "numbered")
    table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1).write.json(path)
    return R.jsonl(spark, path, "n_nationkey int, n_name string", number="message_id")


@query("json_dict_source", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS text, n_regionkey AS region FROM nation")
def json_dict_source(spark, d):
    path = shared_path(spark, "dict")
    rows = table(spark, d, "nation").select(F.lit(0).alias("g"), F.col("n_nationkey").cast("string").alias("k"), F.struct(F.col("n_name").alias("text"), F.col("n_regionkey").alias("region")).alias("v"))
    rows.groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).select("value").coalesce(1).write.text(path)
    return R.json_dict(spark, path, "text:string,region:int")


@query("container_source", "SELECT CAST(NULL AS VARCHAR) AS split, n_name AS text FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'train', n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT NULL, n_name FROM nation WHERE n_regionkey = 2")
def container_source(spark, d):
    path = shared_path(spark, "container")
    n = table(spark, d, "nation").select("n_regionkey", F.struct(F.col("n_name").alias("text")).alias("v"))
    part = lambda k: n.where(f"n_regionkey = {k}").groupBy("n_regionkey").agg(F.collect_list("v").alias("a"))
    part(0).select(F.to_json("a").alias("value")).coalesce(1).write.mode("append").text(path)
    part(1).select(F.to_json(F.struct(F.col("a").alias("train"))).alias("value")).coalesce(1).write.mode("append").text(path)
    part(2).select(F.to_json(F.struct(F.col("a").alias("records"))).alias("value")).coalesce(1).write.mode("append").text(path)
    return R.container(spark, path, "text:string")


@query("merged_sources", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'late' ELSE 'early' END AS origin FROM customer")
def merged_sources(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return R.merged([c.withColumn("origin", F.lit("early")), c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("late"))], "c_custkey")


@query("csv_source_with_method", "SELECT r_name AS label, CAST(r_regionkey AS DOUBLE) AS rate, 'tfidf' AS method, 'code' AS level FROM region UNION ALL SELECT r_name, r_regionkey, 'lsa', CAST(NULL AS VARCHAR) FROM region")
def csv_source_with_method(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("label"), F.col("r_regionkey").cast("double").alias("rate"))
    path = shared_path(spark, "csv")
    K.csv(r, f"{path}/a", ["label", "rate"])
    K.csv(r, f"{path}/b", ["label", "rate"])
    _rename(spark, f"{path}/a", f"{path}/tfidf_code_rates.csv")
    _rename(spark, f"{path}/b", f"{path}/rates-of-lsa.csv")
    return R.csv_with_method(spark, f"{path}/*.csv", "label string, rate double")


def _rename(spark, folder: str, to: str) -> None:
    """The one part file of a folder under another name."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(to)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), target)


@query("lenient_csv_source", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS p_size FROM part")
def lenient_csv_source(spark, d):
    path = shared_path(spark, "lenient")
    table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS STRING) ELSE 'n/a' END AS p_size")).write.csv(path, header=True)
    return R.lenient_csv(spark, path, {"p_partkey": "bigint", "p_size": "int"})


@query("topic_source", "SELECT p_type AS topic, list_sort(list(DISTINCT p_brand)) AS words FROM part GROUP BY 1")
def topic_source(spark, d):
    path = shared_path(spark, "topics")
    table(spark, d, "part").select(F.col("p_type").alias("topic"), F.col("p_brand").alias("word")).distinct().write.csv(path, header=True)
    return R.topics(spark, path)


@query("graph_file_source", "SELECT CAST(n_nationkey AS VARCHAR) AS graph_id, 'a' AS source, 'b' AS target, 'next' AS label FROM nation")
def graph_file_source(spark, d):
    path = shared_path(spark, "graphs")
    node, edge = F.struct(F.lit("a").alias("id"), F.col("n_name").alias("label")), F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("next").alias("dep"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("graph_id"), F.array(node, F.struct(F.lit("b").alias("id"), F.col("n_name").alias("label"))).alias("nodes"), F.array(edge).alias("links"))
    K.by_key(rows, path, "graph_id")
    return R.graph_files(spark, path)[1].select("graph_id", "source", "target", "label")


@query("checkpoint_resumed", "SELECT c_custkey, c_name FROM customer")
def checkpoint_resumed(spark, d):
    path, final = shared_path(spark, "resume"), shared_path(spark, "final")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    K.append_missing(c.where("c_custkey % 3 = 0"), path, "c_custkey")
    K.append_missing(c, path, "c_custkey")
    K.finish(spark, path, final, "c_custkey", "c_custkey long, c_name string")
    return spark.read.schema("c_custkey long, c_name string").json(final)


@query("valid_and_invalid_sink", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'negative' END AS reason FROM supplier")
def valid_and_invalid_sink(spark, d):
    path = shared_path(spark, "validity")
    K.valid_and_invalid(table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "negative").alias("reason")), path)
    good = spark.read.schema("s_suppkey long").json(f"{path}/valid").withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(spark.read.schema("s_suppkey long, reason string").json(f"{path}/invalid"))


@query("index_cache", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def index_cache(spark, d):
    path = shared_path(spark, "index")
    build = lambda: table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    K.build_or_load(spark, path, build)
    return K.build_or_load(spark, path, build)


@query("coded_source", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS intent FROM orders")
def coded_source(spark, d):
    return R.coded(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("intent")), "intent", {0: "zero", 1: "one"})


@query("streamed_label_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type AS label, count(*) AS count FROM events GROUP BY 1, 2")
def streamed_label_counts(spark, d):
    """Counts by event-time hour of all events there are, by a stream run to its end; the last hours are closed by their watermark only, so the sink is complete."""
    out, state = shared_path(spark, "stream"), shared_path(spark, "state")
    schema = table(spark, d, "events").schema
    events = S.read_events(spark, f"{d}/event[s].parquet", schema)  # a glob, as a stream takes a single file for a folder otherwise
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    name = "stream_" + uuid.uuid4().hex
    counts = S.windowed_counts(events, "ts", "event_type", late="3650 days")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("json_array_source", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS n_regionkey FROM nation")
def json_array_source(spark, d):
    """One JSON list a region, each in a file of its own."""
    path = shared_path(spark, "array")
    rows = table(spark, d, "nation").select("n_regionkey", F.struct("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey")).alias("v"))
    lists = rows.groupBy("n_regionkey").agg(F.to_json(F.collect_list("v")).alias("value"))
    lists.repartition(5, "n_regionkey").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.json_array(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("pretty_json_sink", "SELECT CAST(2 + count(*) * 4 AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS records, CAST(sum(r_regionkey) AS BIGINT) AS keys FROM region")
def pretty_json_sink(spark, d):
    """An indented list: a line for each bracket, brace and field; read again it gives its records."""
    path = shared_path(spark, "pretty")
    K.pretty_json(table(spark, d, "region").select("r_regionkey", "r_name"), path)
    lines = spark.read.text(path).agg(F.count("*").alias("lines"))
    records = R.json_array(spark, path, "r_regionkey long, r_name string").agg(F.count("*").alias("records"), F.sum("r_regionkey").alias("keys"))
    return lines.crossJoin(records)  # one row each


@query("sniffed_source", "SELECT 'dict' AS shape, CAST(n_nationkey AS VARCHAR) AS id, n_name AS text FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'lines', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE n_regionkey >= 2")
def sniffed_source(spark, d):
    """Records by id in one file, records a line in the other; the reader tells which is which."""
    by_id, lines = shared_path(spark, "sniffed"), shared_path(spark, "sniffed")
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text"))
    few = n.where("n_regionkey < 2").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct("text"))))).alias("value"))
    few.select("value").coalesce(1).write.text(by_id)
    n.where("n_regionkey >= 2").select("id", "text").coalesce(1).write.json(lines)
    read = lambda path, shape: R.sniffed(spark, path, "text:string").select(F.lit(shape).alias("shape"), "id", "text")
    return read(by_id, "dict").unionByName(read(lines, "lines"))


_BRANDS = "SELECT p_mfgr, p_brand, row_number() OVER (PARTITION BY p_mfgr ORDER BY p_brand) AS r FROM (SELECT DISTINCT p_type AS p_mfgr, p_type || ' ' || p_brand AS p_brand FROM part)"


def _sheet(spark, d):
    """A codebook's sheet of types and their brands: a code stands in its first row only, every brand numbers two entries in its definition."""
    path = shared_path(spark, "sheet")
    brands = table(spark, d, "part").select(F.col("p_type").alias("p_mfgr"), F.concat_ws(" ", "p_type", "p_brand").alias("p_brand")).distinct()
    first = brands.groupBy("p_mfgr").agg(F.min("p_brand").alias("least"))
    rows = brands.join(first, "p_mfgr").select(
        "p_mfgr", "p_brand", F.when(F.col("p_brand") == F.col("least"), F.col("p_mfgr")).alias("CODE"), F.when(F.col("p_brand") == F.col("least"), F.concat(F.lit("by "), "p_mfgr")).alias("CODE DEFINITION"),
        F.col("p_brand").alias("SUB-CODE"), F.concat(F.lit("What follows.\n1. Old "), "p_brand", F.lit(": before\n2. New "), "p_brand", F.lit(": after")).alias("SUB-CODE DEFINITION"),
    )
    rows.coalesce(1).sortWithinPartitions("p_mfgr", "p_brand").drop("p_mfgr", "p_brand").write.csv(path, header=True, escape='"')
    return R.codebook_sheet(spark, path)


@query("codebook_sheet_source", f'SELECT CASE WHEN r = 1 THEN p_mfgr END AS "CODE", CASE WHEN r = 1 THEN \'by \' || p_mfgr END AS "CODE DEFINITION", p_brand AS "SUB-CODE", CAST(row_number() OVER (ORDER BY p_mfgr, p_brand) - 1 AS BIGINT) AS row FROM ({_BRANDS}) b')
def codebook_sheet_source(spark, d):
    return _sheet(spark, d).select("CODE", "CODE DEFINITION", "SUB-CODE", "row")


_ID = "regexp_replace(trim({x}), '\\s+', '_', 'g')"


@query("codebook_nodes", f"""WITH b AS ({_BRANDS}) SELECT {_ID.format(x="p_mfgr")} AS id, 'code' AS type, 'by ' || p_mfgr AS description FROM b WHERE r = 1
    UNION ALL SELECT {_ID.format(x="p_brand")}, 'subcode', 'What follows.' || chr(10) || '1. Old ' || p_brand || ': before' || chr(10) || '2. New ' || p_brand || ': after' FROM b
    UNION ALL SELECT {_ID.format(x="a || p_brand")}, 'subsubcode', a || p_brand FROM b, (VALUES ('Old '), ('New ')) v(a)""")
def codebook_nodes(spark, d):
    nodes, _ = H.parse_sheet(_sheet(spark, d))
    return nodes.select("id", "type", F.get("description", 0).alias("description"))


@query("codebook_edges", f"""WITH b AS ({_BRANDS}) SELECT {_ID.format(x="p_mfgr")} AS source, {_ID.format(x="p_brand")} AS target FROM b
    UNION ALL SELECT {_ID.format(x="p_brand")}, {_ID.format(x="a || p_brand")} FROM b, (VALUES ('Old '), ('New ')) v(a)""")
def codebook_edges(spark, d):
    return H.parse_sheet(_sheet(spark, d))[1]
