"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import stage, word_count

#: A mix is configured by source; more sources than this are an error, not a cut.
MAX_SOURCES = 1_000_000
#: Bits of a document's draw, and how many of them name its bucket.
DRAW_BITS, BUCKET_BITS = 60, 12


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: int, max_epochs: int) -> list[float]:
    """Targets that share ``total`` by weight, none above ``max_epochs`` times its size.

    Sources above their cap are clamped and the excess is shared again by weight
    among the others, until none is above (or all are clamped).
    """
    caps = [max_epochs * s for s in sizes]
    clamped = [False] * len(sizes)
    while True:
        left = total - sum(c for c, k in zip(caps, clamped) if k)
        weight = sum(w for w, k in zip(weights, clamped) if not k)
        targets = [float(c) if k else left * w / weight for c, w, k in zip(caps, weights, clamped)]
        above = [not k and t > c for t, c, k in zip(targets, caps, clamped)]
        if not any(above):
            return targets
        clamped = [k or a for k, a in zip(clamped, above)]


def cycle_weights(cycle: Sequence[int]) -> Callable[[list], list]:
    return lambda sources: [cycle[i % len(cycle)] for i in range(len(sources))]


def draw(id_col, seed: int):
    """A document's place in the order of fractional repetitions, from its id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def plan(docs: DataFrame, weigh: Callable[[list], list], *, share: float = 1.0, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, sources): each document's size and draw; each source's target and its draws' limit.

    A document is repeated ``whole`` times, and once more if its draw is at most
    ``limit``: the sum of those fractional repetitions comes within half a
    document of what the source still needs, and there are none where it needs
    nothing more. Sums run over buckets of draws first, so that a source of any size is cut within one bucket of 4096.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), seed).alias("u"),
    )
    docs = stage(docs, "mix-docs")
    rows = docs.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["s"] for r in rows]
    targets = water_fill(sizes, weigh([r["source"] for r in rows]), int(sum(sizes) * share) if share != 1.0 else sum(sizes), max_epochs) if rows else []
    whole = [min(max_epochs, int(t // s)) if s else 0 for t, s in zip(targets, sizes)]
    schema = "source string, source_size long, target double, whole int, need double"
    sources = spark.createDataFrame([(r["source"], s, t, w, t - w * s) for r, s, t, w in zip(rows, sizes, targets, whole)], T._parse_datatype_string(schema))

    bucket = F.shiftright("u", DRAW_BITS - BUCKET_BITS).cast("int")
    sums = docs.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    cut = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    cut = cut.join(sources.select(F.col("source").alias("s2"), "need"), F.col("source").eqNullSafe(F.col("s2"))).where("need > 0 and before <= need and need <= before + in_bucket")  # a source at its cap needs none
    cut = stage(cut.groupBy("source").agg(F.max(F.struct("bucket", "before", "need")).alias("c")).select(F.col("source").alias("s2"), F.col("c.bucket").alias("b2"), "c.before", "c.need"), "mix-cut")
    inside = docs.withColumn("bucket", bucket).join(cut, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    inside = inside.groupBy("source", "u").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("need").alias("need"))
    run = F.sum("size").over(W.partitionBy("source").orderBy("u").rowsBetween(W.unboundedPreceding, -1))
    taken = F.col("before") + F.coalesce(run, F.lit(0)) + F.col("size") / 2 <= F.col("need")
    last = inside.withColumn("ok", taken).where("ok").groupBy("source").agg(F.max("u").alias("top"))
    floor = cut.select("s2", F.shiftleft(F.col("b2").cast("long"), DRAW_BITS - BUCKET_BITS).alias("floor"))
    limits = floor.join(last, F.col("s2").eqNullSafe(F.col("source")), "left").select("s2", F.coalesce("top", F.col("floor") - 1).alias("limit"))
    sources = sources.join(limits, F.col("source").eqNullSafe(F.col("s2")), "left").select("source", "source_size", "target", "whole", F.coalesce("limit", F.lit(-1)).alias("limit"))
    return docs, stage(sources, "mix-sources")


def mix(docs: DataFrame, weigh: Callable[[list], list], **options) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken of every document.

    Size is the number of words; null or empty texts have none and take part with
    0. A null source is a source of its own, last in order. Rows that repeat an id
    share its draw. Reruns with the same seed agree, however the rows are dealt.
    An empty table gives no rows; other columns are ignored.
    """
    rows, sources = plan(docs, weigh, **options)
    rows = rows.join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
    repeats = (F.col("whole") + (F.col("u") <= F.col("limit")).cast("int")).cast("int")
    rows = rows.withColumn("repeats", repeats)
    return rows.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_rows(docs: DataFrame, weigh: Callable[[list], list], *, seed: int = 17, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, all columns kept."""
    columns = docs.columns
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    _, sources = plan(docs, weigh, seed=seed, **options)
    sources = sources.select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("limit").alias("__limit"))
    rows = docs.join(sources, docs[source_col].cast("string").eqNullSafe(F.col("__source")))
    repeats = F.col("__whole") + (draw(docs[id_col], seed) <= F.col("__limit")).cast("int")
    rows = rows.withColumn("__repeats", repeats).where("__repeats > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select(*columns)
