"""Label counts over streams: an addition, as the corpus's own tools know no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, ts: str, label: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each label by event-time window; events later than ``late`` are left out."""
    rows = events.withWatermark(ts, late)
    counts = rows.groupBy(F.window(ts, width), F.col(label).alias("label")).agg(F.count("*").alias("count"))
    return counts.select(F.col("window.start").alias("window_start"), "label", "count")


def first_seen(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, into Parquet."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
