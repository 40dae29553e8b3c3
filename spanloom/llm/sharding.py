"""Sharding by sampled splitters over (text hash, id, row) keys, near equal in bytes."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage

#: Ranges per shard before any is subdivided, sampled keys per range, and the share
#: of a range's mean up to which a group of equal texts is kept in one shard.
RANGES_PER_SHARD, KEYS_PER_RANGE, WHOLE = 32, 8, 2 / 3
#: Rows of a range on average at most; and a range that, but for its largest row, is above so many times the mean is subdivided.
RANGE_ROWS, OVERFULL = 500_000, 4
#: Rounds of drawing after which no progress is an error (each draws anew, so that one has always been enough so far).
ROUNDS = 40

_LOWEST = -(2**63)


def _splitters(keys: list[tuple[int, int, int, float]], pieces: int) -> list[tuple[int, int, int]]:
    """Keys at the weighted quantiles; a hash that spans no whole piece is not cut inside."""
    keys = sorted(keys)
    weight: dict[int, float] = {}
    for h, *_, w in keys:
        weight[h] = weight.get(h, 0.0) + w
    total, run, found, aim = sum(weight.values()), 0.0, set(), 1
    for h, d, r, w in keys:
        run += w
        while aim < pieces and run >= aim * total / pieces:
            found.add((h, d, r) if weight[h] >= total / pieces else (h, _LOWEST, _LOWEST))
            aim += 1
    return sorted(found)


def _range_of(splitters: list[tuple[int, int, int]]):
    firsts = np.array([h for h, *_ in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def of(h: pd.Series, d: pd.Series, r: pd.Series) -> pd.Series:
        hs = h.to_numpy(np.int64)
        low, out = np.searchsorted(firsts, hs, "left"), np.searchsorted(firsts, hs, "right")
        for i in np.nonzero(low != out)[0]:
            out[i] = bisect.bisect_right(splitters, (int(hs[i]), int(d.iloc[i]), int(r.iloc[i])))
        return pd.Series(out.astype(np.int32))

    return of


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Law ``bytes``: shards are consecutive ranges of (text hash, id) and differ
    from an equal share by no more than a document or the group kept whole there.
    Size is a text's UTF-8 bytes plus 16; a null text counts as empty, a null id
    sorts first. Copies of a text lie together, in one shard where their bytes are
    at most two thirds of a range's mean (2 % of a shard, where it has 32 ranges),
    else cut where the share ends. Rows that repeat
    both an id and a text are told apart by their place in a written table, so they
    too are dealt to ranges; which of them comes first means nothing. An empty
    table gives no rows; other columns are ignored.

    Only sampled keys (8 for each range) and a total for each range are collected;
    there are 32 ranges for each shard, or as many as hold 500,000 rows each.
    Ranges that come out overfull are sampled and subdivided again until none is;
    rows are then numbered by range.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ).withColumns({"d": F.coalesce("doc_id", F.lit(_LOWEST)), "r": F.monotonically_increasing_id()})
    rows = stage(rows, "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pieces = max(shards * RANGES_PER_SHARD, -(-n // RANGE_ROWS))

    def sample(df: DataFrame, of: float, wanted: int, salt: int) -> list[tuple[int, int, int, float]]:
        unit = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "d", "h", "r"), F.lit(1 << 30)) / float(1 << 30)
        chance = F.col("size") * (wanted / max(of, 1.0))
        drawn = df.where(unit < chance).select("h", "d", "r", F.greatest(F.col("size"), F.lit(of / wanted)).alias("w"))
        return [tuple(r) for r in drawn.collect()]

    cuts = _splitters(sample(rows, total, pieces * KEYS_PER_RANGE, 0), pieces)
    for k in range(1, ROUNDS + 2):
        named = rows.withColumn("range", _range_of(cuts)("h", "d", "r"))
        sums = named.groupBy("range").agg(F.sum("size").alias("b"), F.max("size").alias("m"), F.count("*").alias("c"))
        found = {r["range"]: r for r in sums.collect()}
        over = [i for i, r in found.items() if r["b"] - r["m"] > OVERFULL * total / pieces]
        if not over:
            break
        if k > ROUNDS:
            raise RuntimeError(f"{len(over)} ranges are still overfull after {ROUNDS} rounds")
        of = sum(found[i]["b"] for i in over)
        wanted = min(pieces * KEYS_PER_RANGE, 4 * KEYS_PER_RANGE * len(over) + int(KEYS_PER_RANGE * of * pieces / total))
        by: dict[int, list] = {}
        for key in sample(named.where(F.col("range").isin(over)), of, wanted, k):
            by.setdefault(bisect.bisect_right(cuts, key[:3]), []).append(key)
        more: set[tuple[int, int, int]] = set(cuts)
        for i, keys in by.items():
            more |= set(_splitters(keys, max(2, round(found[i]["b"] * pieces / total))))
        cuts = sorted(more)
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = sums.select("range", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("c0"))

    order = W.partitionBy("range").orderBy("h", "d", "r")
    group = W.partitionBy("range", "h")
    placed = named.withColumns({"rn": F.row_number().over(order), "run": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
    placed = placed.withColumns({"g0": F.min("run").over(group), "g": F.sum("size").over(group)}).join(F.broadcast(starts), "range")
    whole = F.col("g") * pieces <= WHOLE * total
    twice = F.when(whole, 2 * F.col("g0") + F.col("g")).otherwise(2 * F.col("run") + F.col("size")) + 2 * F.col("b0")
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(twice * shards / max(2 * total, 1))).cast("int").alias("shard"), (F.col("c0") + F.col("rn")).alias("at"),
    )
    placed = stage(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
