"""Exact dedup by distributed most-significant-digit radix partitioning.

The first digit is a text's byte length with its first bytes; each further digit
is the next, longer run of bytes. After each digit only groups of two or more
rows whose texts have not ended are split again. Two rows are equal when they
have shared every digit to the end of their texts, so equality rests on bytes
and on no digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flag_keys, stage

#: Bytes of the first digit, and by how much each next digit is longer.
FIRST, FACTOR = 64, 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, factor: int = FACTOR, payload: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and ``payload``.

    Null texts equal empty ones. Of equal texts the row with the largest id
    stays; a null id is smaller than any other; of rows tied on that id exactly
    one stays. An empty table gives no rows. Other columns are ignored, whatever
    their names. Very long texts only cost more digits. ``payload`` names further
    columns of ``docs`` to carry through, as ``x_<name>``.

    A filter clears rows whose first digit nobody shares where they lie; only the
    others' texts are written down, and cross the network one digit at a time as
    long as they are shared. The many rows of a hot group are counted where they
    lie before any shuffle, and its joins are such as can be split.
    """
    extra = [F.col(c).alias(f"x_{c}") for c in payload or []]
    names = [f"x_{c}" for c in payload or []]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *extra)
    base = base.withColumns({"n": F.octet_length("t").cast("long"), "digit": _digit(0, first)})
    many = base.groupBy("n", "digit").agg(F.count("*").alias("c")).where("c > 1").select(F.xxhash64("n", "digit").alias("g"))
    base = flag_keys(base.withColumn("g", F.xxhash64("n", "digit")), "g", stage(many, "radix-first"), "open")
    digest = F.sha2("t", 256).alias("text_sha256")
    alone = base.where("NOT open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest, *names)
    rows = stage(base.where("open").select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "t", digest, *names), "radix-rows")
    live = rows.select("row", "doc_id", "n", "t")

    done, at, width = [], 0, first
    level = live.select("row", "doc_id", "n", F.col("n").alias("node"), _digit(0, first).alias("digit"))
    while True:
        end = at + width
        groups = level.groupBy("node", "digit").agg(F.count("*").alias("c"), F.min("row").alias("child"), F.max("doc_id").alias("keep_id")).where("c > 1")
        split = level.join(stage(groups, "radix-groups").hint("merge"), ["node", "digit"], "inner").select("row", "doc_id", "n", F.col("child").alias("node"), "c", "keep_id")
        split = stage(split, "radix-level")
        done.append(split.where(F.col("n") <= end))
        rest = split.where(F.col("n") > end)
        if rest.isEmpty():
            break
        at, width = end, width * factor
        text = live.where(F.col("n") > end).select("row", _digit(at, width).alias("digit"))
        level = rest.select("row", "doc_id", "n", "node").join(text.hint("merge"), "row")
    ended = reduce(DataFrame.unionByName, done)
    first_row = ended.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("node").agg(F.min("row").alias("keep_row"))
    ended = ended.join(stage(first_row, "radix-kept"), "node").select("row", "keep_id", F.col("c").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"))
    single = F.col("group_size").isNull()
    met = rows.drop("t").join(ended.hint("merge"), "row", "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"), "text_sha256", *names,
    )
    return alone.unionByName(met)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    columns = docs.columns
    kept = exact_groups(docs, id_col, text_col, payload=columns).where("kept")
    return kept.select(*[F.col(f"x_{c}").alias(c) for c in columns])


def _digit(at: int, width: int):
    return F.substring(F.col("t").cast("binary"), at + 1, width)
