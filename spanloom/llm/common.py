"""Shared storage, key filters, word counting and connected components for the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a key filter for each key, all of them at most (8 MB), and those of each of its rows (which ``bitmap_construct_agg`` fixes).
KEY_BITS, FILTER_BITS, ROW_BITS = 64, 1 << 26, 1 << 15
#: Rows of a key beyond which they are spread.
HOT = 1000
#: Nodes that a partition's components may remember before they are passed on.
FOREST_NODES = 1_000_000

#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may lack one and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop(entries: list[tuple[SparkSession, str]]) -> None:
    for spark, path in entries:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session is already gone; the folder's owner cleans up
            return


def clean() -> None:
    """Delete all that was staged so far; call it when no result that rests on it is needed any more."""
    entries = list(_written)
    _written.clear()
    _drop(entries)


atexit.register(clean)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those staged by the function that this yields."""
    at, kept = len(_written), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        kept.append(_written[-1])
        return out

    try:
        yield keep
    finally:
        own = _written[at:]
        _written[at:] = kept
        _drop([entry for entry in own if entry not in kept])


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: a lost executor costs only the tasks it held, and later
    joins see real sizes, so that small sides are broadcast only when measured small.
    What was shuffled for the table is deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def flag_keys(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether their ``key`` may be among ``keys`` (a table of one column); surely false where it isn't set.

    A filter of ``KEY_BITS`` bits for each key, but ``FILTER_BITS`` at most, goes to
    the rows, which stay where they lie. A set flag is wrong by chance, as often as
    the filter is full; what is flagged has to be checked. Null keys are not
    flagged. As many keys as bits flag nearly all rows: then a check costs what it
    would without.
    """
    keys = keys.select(F.col(keys.columns[0]).alias("k")).where("k IS NOT NULL")
    size = min(FILTER_BITS, max(ROW_BITS, KEY_BITS * keys.count()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)) + 1  # noqa: E731  (counted from one, as bitmap functions do)
    spots = keys.select(place(F.col("k")).alias("p"))
    bits = spots.groupBy(F.bitmap_bucket_number("p").alias("__row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = F.pmod(place(F.col(key)) - 1, F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substr(F.col("__bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), at.bitwiseAND(F.lit(7)))
    marked = rows.withColumn("__row", F.when(F.col(key).isNotNull(), F.bitmap_bucket_number(place(F.col(key)))))
    marked = marked.join(F.broadcast(bits), "__row", "left")  # FILTER_BITS / ROW_BITS rows at most
    return marked.withColumn(flag, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("__row", "__bits")


def join_spread(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with their group's other columns, null where there is none; ``groups`` has one row for each ``key`` and says in ``size`` how many rows have it.

    Rows of groups above ``HOT`` rows, and of what the key filter takes for one,
    are dealt over as many parts as there are shuffle partitions, and those groups
    stand in each part; so no task gets all rows of a key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = groups.where(F.col(size) > HOT).select(key)
    part = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    left = flag_keys(rows, key, hot, "__hot").withColumn("__part", part).drop("__hot")
    right = flag_keys(groups.drop(size), key, hot, "__hot").withColumn("__part", every).drop("__hot")
    return left.join(right.hint("merge"), [key, "__part"], "left").drop("__part")


def word_count(text: Column) -> Column:
    """Number of ``WORD`` runs; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's edges as stars of its own components; passed on whenever ``FOREST_NODES`` are known."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> Iterator[pd.DataFrame]:
        out = [(x, r) for x in root if (r := find(x)) != x]
        root.clear()
        for i in range(0, len(out), 100_000):
            yield pd.DataFrame(out[i : i + 100_000], columns=["u", "v"])

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > FOREST_NODES:
            yield from stars()
    yield from stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Each partition first reduces its edges to stars. Then, in rounds, every node
    hooks to its smallest neighbour, hooks are followed to their ends, and the
    edges are drawn anew between those, until none is left. Rounds are written to
    the shared folder; only counts reach the driver. Self-links and nulls are
    ignored. A node of many edges is aggregated where they lie, and its joins can
    be split.
    """
    with scratch() as keep:
        return _components(edges, keep)


def _components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    pairs = stage(edges.where("a <> b").select("a", "b").mapInPandas(_forest, "u long, v long").distinct(), "links")
    found = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        hook = stage(hook, "hooks")
        while True:
            ahead = hook.select(F.col("node").alias("to"), F.col("to").alias("end"))
            hook = stage(hook.join(ahead, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "hooks")
            if not hook.where("moved").limit(1).count():
                break
            hook = hook.select("node", "to")
        hook = hook.select("node", "to")
        a, b = hook.select(F.col("node").alias("u"), F.col("to").alias("x")), hook.select(F.col("node").alias("v"), F.col("to").alias("y"))
        drawn = pairs.join(a, "u").join(b, "v").where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        if found is None:
            found = hook.select("node", F.col("to").alias("component"))
        else:
            found = found.join(hook.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        pairs = stage(drawn.distinct(), "links")
    if found is None:
        found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return keep(found, "components")
