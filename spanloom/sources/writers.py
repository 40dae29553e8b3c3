"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the pretty printer takes to the driver at most; more is an error.
MAX_PRETTY_ROWS = 100_000


def pretty_json(df: DataFrame, path: str, max_rows: int = MAX_PRETTY_ROWS) -> None:
    """One indented JSON list, for results that people read."""
    rows = df.limit(max_rows + 1).toJSON().collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write them with df.write.json")
    text = json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)
    spark = df.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def append_missing(df: DataFrame, path: str, key: str, spark: SparkSession | None = None) -> int:
    """Append the rows whose key isn't there yet; returns their number. A stopped run goes on where it ended."""
    spark = spark or df.sparkSession
    try:
        done = spark.read.json(path, schema=f"`{key}` {dict(df.dtypes)[key]}")
        rows = df.join(done.distinct(), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = df
    n = rows.count()
    if n:
        rows.write.mode("append").json(path)
    return n


def finish(spark: SparkSession, checkpoint: str, path: str, key: str, schema: str) -> None:
    """The checkpoint's rows, one for each key, as the final table."""
    spark.read.schema(schema).json(checkpoint).dropDuplicates([key]).write.mode("overwrite").json(path)


def by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key, each written by one task's pass over its sorted rows."""
    df.repartition(key).sortWithinPartitions(key).write.mode("overwrite").partitionBy(key).json(path)


def valid_and_invalid(df: DataFrame, path: str) -> None:
    """Rows with a ``reason`` apart from those without."""
    df.where("reason IS NULL").drop("reason").write.mode("overwrite").json(f"{path}/valid")
    df.where("reason IS NOT NULL").write.mode("overwrite").json(f"{path}/invalid")


def build_or_load(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and written first if it isn't there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tree_rows(df: DataFrame, source: str, target: str) -> DataFrame:
    """What a tree drawing needs: each edge with the depth order of its ends left to the drawer."""
    return df.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()
