"""Embedding near-dedup with a random-projection tree forest.

Dense groups come first: vectors that reach the threshold with a pivot, drawn
where the sample is dense, are compared exactly with all vectors that could link
with them (angles add up, so these lie within twice the link's angle of the
pivot), in bounded tiles. The others go down trees: each splits by random
directions at the middle of a fitted sample, and rows near a split go down both
sides, until leaves are small. The first levels are fitted on one sample of the
table; nodes that are still large are fitted again, each on its own sample, as
deep as it takes. Trees differ in their directions; vectors are compared within
leaves, verified in double precision, and united.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_spread, scratch, stage

#: Trees, vectors in a leaf, and the share of a node's rows on each side of a split that go down both sides.
TREES, LEAF, SPILL = 8, 128, 0.07
#: Vectors that the first splits are fitted on at most, and how many of them a leaf should have.
MAX_SAMPLE, LEAF_SAMPLE = 50_000, 32
#: Levels that a large node is fitted again for at once, its rows that one task deals, and rounds without which it is compared in blocks.
MORE_LEVELS, DEALT, ROUNDS = 7, 20_000, 12
#: Bytes that trees send at once, unless a vector's four bytes a number make more in all.
WAVE_BYTES = 1 << 28
#: Others of the sample that a pivot homes at least, and vectors on each side of a tile.
DENSE, TILE = 4, 500


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator, spill: float = SPILL) -> list[tuple[np.ndarray, float, float]]:
    """Splits of a tree in heap order: direction, and the values up to which left and from which right is taken."""
    splits, nodes = [], [sample]
    for _ in range(depth):
        below = []
        for rows in nodes:
            direction = rng.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            at = rows @ direction
            low, high = np.quantile(at, [0.5 - spill, 0.5 + spill]) if len(at) else (0.0, 0.0)
            splits.append((direction, float(low), float(high)))
            below += [rows[at <= high], rows[at >= low]]
        nodes = below
    return splits


def descend(x: np.ndarray, splits: list, depth: int, part: int = 0, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for each leaf that each row comes to, of those below the ``part``-th node of ``level``."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for at_level in range(depth + 1):
        if at_level == level:
            own = node == (1 << level) - 1 + part
            row, node = row[own], node[own]
        if at_level == depth:
            break
        at = np.empty(len(row))
        low, high = np.empty(len(row)), np.empty(len(row))
        for n in np.unique(node):
            own = node == n
            at[own] = x[row[own]] @ splits[n][0]
            low[own], high[own] = splits[n][1:]
        left, right = at <= high, at >= low
        row = np.concatenate([row[left], row[right]])
        node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, in single precision where that holds all of it."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return [a.tobytes() if same else b.tobytes() for a, b, same in zip(short, x, (short == x).all(1))]


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    """What ``_packed`` made, in double precision."""
    kinds = {len(v) for v in values}
    if len(kinds) < 2:
        return np.frombuffer(b"".join(values), np.float32 if kinds == {4 * dim} else float).reshape(len(values), dim).astype(float)
    return np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else float) for v in values], float)


def leaf_pairs(x: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i, j), i < j, of rows whose cosine is ``threshold`` or more, in blocks; near the threshold in plain double precision."""
    unit, found = _unit(x), []
    for lo in range(0, len(x), 1000):
        i, j = np.nonzero(unit[lo : lo + 1000] @ unit[lo:].T >= threshold - 1e-9)
        i, j = i[i < j] + lo, j[i < j] + lo
        found += [np.stack([i[k : k + 50_000], j[k : k + 50_000]], 1)[_cosines(x[i[k : k + 50_000]], x[j[k : k + 50_000]]) >= threshold] for k in range(0, len(i), 50_000)]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dense_pivots(sample: np.ndarray, threshold: float, dense: int = DENSE) -> np.ndarray:
    """Rows of the sample such that few others reach ``threshold`` with any row that reaches it with none of them."""
    counts, step = np.zeros(len(sample), np.int64), max(1, (1 << 23) // max(1, len(sample)))
    for lo in range(0, len(sample), step):
        counts[lo : lo + step] = (sample[lo : lo + step] @ sample.T >= threshold).sum(1) - 1
    free, pivots = np.ones(len(sample), bool), []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < dense:
            break
        if free[i]:
            own = free & (sample @ sample[i] >= threshold)
            if own.sum() > dense:
                pivots.append(i)
                free &= ~own
    return sample[pivots]


def tile_counts(x: np.ndarray, y: np.ndarray, weigh_x: np.ndarray, weigh_y: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights that link with each row of x, and with each of y, and links as stars that join what all links join."""
    ux, uy = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    linked = np.empty((len(x), len(y)), bool)
    for lo in range(0, len(x), 500):
        cosine = ux[lo : lo + 500] @ uy.T
        linked[lo : lo + 500] = cosine >= threshold
        i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
        linked[lo + i, j] = _cosines(x[lo + i], y[j]) >= threshold
    linked &= ids_x[:, None] != ids_y[None, :]
    counts = (linked * weigh_y).sum(1), (weigh_x[:, None] * linked).sum(0)
    stars, left = [], linked.any(1)
    while left.any():
        own, met = np.zeros(len(x), bool), np.zeros(len(y), bool)
        ahead = np.array([left.argmax()])
        while len(ahead):
            own[ahead] = True
            new = linked[ahead].any(0) & ~met
            met |= new
            ahead = np.nonzero(linked[:, new].any(1) & ~own)[0]
        left &= ~own
        ids = np.unique(np.concatenate([ids_x[own], ids_y[met]])).tolist()
        stars += [(ids[0], i) for i in ids[1:]]
    return *counts, stars


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = lambda p, q: np.einsum("ij,ij->i", p, q)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors that are null, empty, zero or hold a null or a non-finite number link
    with nothing, as do those of different lengths with each other and rows
    without an id (whose component is null and which are not kept). Equal vectors
    are one class: it is compared once, and counts as often as it occurs. An empty
    table gives no rows; other columns are ignored.

    Pivots and the first splits are fitted on a seeded sample of at most
    ``MAX_SAMPLE`` vectors. All links of vectors that a pivot homes are found;
    every other vector goes down every tree to its leaves, at any size of the
    table, and links between those can be missed: a pair at the threshold stays
    together in 95.6 % of a tree's splits, so that eight trees of 20 levels keep 98 %.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    able = F.coalesce((F.size("v") > 0) & F.forall("v", good) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("v", F.when(able, F.col("v")))
    digest = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(7), "v").alias("y")))  # 128 bits name a vector where only its result is looked up
    with scratch() as keep:
        groups = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("c"), F.count("*").alias("many"))
        groups = stage(groups, "forest-classes")
        links = counts = None
        for dim, n in ((r["d"], r["n"]) for r in groups.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
            own, more = _links(groups.where(F.size("v") == dim), dim, n, threshold, trees, leaf, seed)
            links = own if links is None else links.unionByName(own)
            if more is not None:
                counts = more if counts is None else counts.unionByName(more)
        if links is None:
            links = spark.createDataFrame([], "a long, b long, many_a long, many_b long")
        links = stage(links.distinct(), "forest-links")
        linked = links.select(F.col("a").alias("c"), F.col("many_b").alias("others")).unionByName(links.select(F.col("b").alias("c"), F.col("many_a").alias("others")))
        links = links.select("a", "b")
        if counts is not None:
            linked = linked.unionByName(counts.where("b IS NULL").select(F.col("a").alias("c"), F.col("n").alias("others")))
            links = links.unionByName(counts.where("b IS NOT NULL").select("a", "b"))
        component = connected_components(links).select(F.col("node").alias("c"), "component")
        linked = linked.groupBy("c").agg(F.sum("others").alias("others"))
        info = groups.select("c", "many", digest.alias("key")).join(component, "c", "left").join(linked, "c", "left")
        info = keep(info.select("key", F.coalesce("component", "c").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("links"), "many"), "forest-info")
    out = join_spread(rows.select("vec_id", digest.alias("key")), info, "key", "many").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _home(groups: DataFrame, pivots: np.ndarray, dim: int, threshold: float) -> DataFrame:
    """groups with home, the pivot that a vector is nearest to if it reaches ``threshold`` with it (else -1), and near, those of whose homed vectors it may link with one."""
    sent = groups.sparkSession.sparkContext.broadcast(pivots)
    reach = np.cos(min(np.pi, 2 * np.arccos(np.clip(threshold, -1, 1)))) - 1e-6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b["v"]]) if len(b) else np.zeros((0, dim))
            at = x @ sent.value.T / np.linalg.norm(x, axis=1, keepdims=True)
            best = at.argmax(1)
            home = np.where(at[np.arange(len(x)), best] >= threshold, best, -1)
            yield pd.DataFrame({"c": b["c"], "v": b["v"], "many": b["many"], "home": home, "near": [np.nonzero(r >= reach)[0].tolist() for r in at]})

    return groups.select("c", "v", "many").mapInPandas(run, "c long, v array<double>, many long, home int, near array<int>")


def _tiled(homed: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, n): links of homed vectors as stars, and, where b is null, the weight n of others that link with a; each link counts once on each side that is to know it."""
    sizes = homed.select("home", F.explode("near").alias("p")).groupBy("p").agg(F.count("*").alias("near"), F.sum((F.col("home") == F.col("p")).cast("long")).alias("own"))
    sizes = sizes.select("p", F.ceil(F.col("own") / TILE).alias("rows"), F.ceil(F.col("near") / TILE).alias("columns")).where("rows > 0")
    sizes = stage(sizes, "forest-sizes")
    part = lambda n, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    near = homed.select("c", "v", "many", "home", F.explode("near").alias("p")).join(sizes, "p")
    columns = near.select("p", every("rows").alias("i"), part("columns", 2).alias("j"), "c", "v", "many", (F.col("home") >= 0).alias("homed"), F.lit(False).alias("row"))
    rows = homed.withColumn("p", F.col("home")).join(sizes, "p").select("p", part("rows", 1).alias("i"), every("columns").alias("j"), "c", "v", "many", F.lit(True).alias("homed"), F.lit(True).alias("row"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids, many = np.stack(pdf["v"].to_list()).astype(float).reshape(len(pdf), dim), pdf["c"].to_numpy(), pdf["many"].to_numpy()
        row = pdf["row"].to_numpy(bool)
        own, other, stars = tile_counts(v[row], v[~row], many[row], many[~row], ids[row], ids[~row], threshold)
        told = (other > 0) & ~pdf["homed"].to_numpy(bool)[~row]
        counts = pd.DataFrame({"a": np.concatenate([ids[row][own > 0], ids[~row][told]]), "n": np.concatenate([own[own > 0], other[told]])})
        return pd.concat([counts.assign(b=pd.array([None] * len(counts), "Int64")), pd.DataFrame(stars, columns=["a", "b"], dtype="Int64").assign(n=0)])[["a", "b", "n"]].astype("Int64")

    return rows.unionByName(columns).groupBy("p", "i", "j").applyInPandas(compare, "a long, b long, n long")


def _levels(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n / leaf))))


def _links(groups: DataFrame, dim: int, n: int, threshold: float, trees: int, leaf: int, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, many_a, many_b) found by trees, and what ``_tiled`` finds, if anything is dense."""
    spark = groups.sparkSession
    most = max(1, int(math.log2(MAX_SAMPLE / LEAF_SAMPLE)))
    depth = min(_levels(n, leaf), most)
    share = (LEAF_SAMPLE << depth) / max(1, n)
    unit = F.pmod(F.xxhash64(F.lit(seed), "c"), F.lit(1 << 30)) / float(1 << 30)
    drawn = groups.where(unit < share).select("c", "v").collect() if depth else []
    sample = np.array([r["v"] for r in sorted(drawn)], dtype=float).reshape(len(drawn), dim)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    pivots, counts = dense_pivots(sample, threshold, max(DENSE, int(leaf * min(1.0, share) / 4))), None
    if len(pivots):
        homed = stage(_home(groups, pivots, dim, threshold), "forest-homes")
        counts = stage(_tiled(homed, dim, threshold), "forest-tiles")
        groups = homed.where("home < 0")
        n = groups.count()
        depth = min(_levels(n, leaf), most)
        for lo in range(0, len(pivots), 100):
            sample = sample[(sample @ pivots[lo : lo + 100].T).max(1, initial=-2) < threshold]
    forest = spark.sparkContext.broadcast([grow(sample, depth, np.random.default_rng([seed, t])) for t in range(trees)])

    def dealt(own: range, part: int, level: int) -> DataFrame:
        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.stack([np.asarray(v, float) for v in b["v"]]) if len(b) else np.zeros((0, dim))
                unit_x, ids, many, data = _unit(x), b["c"].to_numpy(), b["many"].to_numpy(), np.array(_packed(x) or [b""], dtype=object)
                for t in own:
                    row, node = descend(unit_x, forest.value[t], depth, part, level)
                    yield pd.DataFrame({"tree": t, "node": node + 1, "c": ids[row], "many": many[row], "v": data[row]})

        return groups.select("c", "v", "many").mapInPandas(deal, _DEALT)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return _told(leaf_pairs(_matrix(pdf["v"], dim), threshold), pdf)

    links = None
    for wave in _waves(n, dim, _levels(n, leaf), depth, trees):
        with scratch() as keep:
            parts, found = [dealt(*wave)], []
            if _levels(n, leaf) > depth:
                parts, apart = _deepen(stage(parts[0], "forest-dealt"), dim, leaf, seed)
                found += [_block_links(d, dim, threshold) for d in apart]
            found += [part.groupBy("tree", "node").applyInPandas(compare, _LINKS) for part in parts]
            own = found[0]
            for more in found[1:]:
                own = own.unionByName(more)
            own = keep(own.distinct(), "forest-wave")
        links = own if links is None else links.unionByName(own)
    return links, counts


def _waves(n: int, dim: int, levels: int, depth: int, trees: int) -> list[tuple[range, int, int]]:
    """(trees, node, its level) of which the rows below are on disk together: several trees, one, or a part of one."""
    most = max(WAVE_BYTES, 4 * dim * n)
    tree = max(1.0, n * (4 * dim + 40) * (1 + 2 * SPILL) ** levels)
    if tree <= most:
        step = int(most // tree)
        return [(range(t, min(t + step, trees)), 0, 0) for t in range(0, trees, step)]
    level = min(depth, math.ceil(math.log2(tree / most)))
    return [(range(t, t + 1), part, level) for t in range(trees) for part in range(1 << level)]


_DEALT = "tree int, node long, c long, many long, v binary"
_LINKS = "a long, b long, many_a long, many_b long"


def _told(pairs: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a frame's rows as links, the smaller id first."""
    ids, many = pdf["c"].to_numpy(), pdf["many"].to_numpy()
    i, j = pairs.T
    i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    return pd.DataFrame({"a": ids[i], "b": ids[j], "many_a": many[i], "many_b": many[j]})


def _deepen(dealt: DataFrame, dim: int, leaf: int, seed: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(parts of ``dealt`` whose nodes are small, parts whose nodes no split makes smaller).

    In rounds, each node of more than two leaves' rows is fitted on a sample of its
    own, which one task holds, and its rows are dealt on by tasks of some ``DEALT`` rows.
    """
    done = []
    for _ in range(ROUNDS):
        sizes = dealt.groupBy("tree", "node").agg(F.count("*").alias("size"))
        large = stage(sizes.where(F.col("size") > 2 * leaf), "forest-large")
        if large.isEmpty():
            return [*done, dealt], []
        done.append(dealt.join(large.hint("merge"), ["tree", "node"], "left_anti"))
        rows = dealt.join(large.hint("merge"), ["tree", "node"])
        levels = F.least(F.ceil(F.log2(F.col("size") / leaf)), F.lit(MORE_LEVELS)).cast("int")
        unit = F.pmod(F.xxhash64(F.lit(seed), "c", "node"), F.lit(1 << 30)) / float(1 << 30)
        drawn = rows.withColumn("levels", levels).where(unit * F.col("size") < F.lit(LEAF_SAMPLE) * F.pow(F.lit(2), F.col("levels")))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, node, levels = (int(pdf[c].iloc[0]) for c in ("tree", "node", "levels"))
            x = _unit(_matrix(pdf["v"], dim))
            at = [(low, high) for _, low, high in grow(x, levels, np.random.default_rng([seed, tree, node]))]
            return pd.DataFrame({"tree": [tree], "node": [node], "levels": [levels], "at": [np.array(at).tobytes()]})

        fits = drawn.select("tree", "node", "levels", "v").groupBy("tree", "node").applyInPandas(fit, "tree int, node long, levels int, at binary")
        parts = F.ceil(F.col("size") / DEALT).cast("int")
        fits = fits.join(large, ["tree", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("c", F.lit(5)), parts).cast("int"))  # of the same type, or cogroups would not meet

        def deal(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(own):
                return pd.DataFrame({"tree": pd.Series(dtype="int32"), "node": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "many": pd.Series(dtype="int64"), "v": pd.Series(dtype=object)})
            tree, node, levels = (int(own[c].iloc[0]) for c in ("tree", "node", "levels"))
            rng, splits = np.random.default_rng([seed, tree, node]), []
            for low, high in np.frombuffer(own["at"].iloc[0], float).reshape(-1, 2):
                direction = rng.normal(size=dim)
                splits.append((direction / np.linalg.norm(direction), low, high))
            row, below = descend(_unit(_matrix(pdf["v"], dim)), splits, levels)
            out = pdf[["c", "many", "v"]].iloc[row]
            return out.assign(tree=tree, node=(node << levels) + below - ((1 << levels) - 1))[["tree", "node", "c", "many", "v"]]

        by = ["tree", "node", "part"]
        dealt = stage(rows.select(*by, "c", "many", "v").groupBy(*by).cogroup(fits.select(*by, "levels", "at").groupBy(*by)).applyInPandas(deal, _DEALT), "forest-dealt")
    sizes = dealt.groupBy("tree", "node").agg(F.count("*").alias("size"))
    large = stage(sizes.where(F.col("size") > 2 * leaf), "forest-large")
    return [*done, dealt.join(large.hint("merge"), ["tree", "node"], "left_anti")], [dealt.join(large.hint("merge"), ["tree", "node"])]


def _block_links(rows: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Links within nodes of any size, by pairs of bounded blocks."""
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c", F.lit(6)), blocks))
    left = rows.select("tree", "node", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), blocks - 1)).alias("j"), "c", "many", "v", F.lit(True).alias("left"))
    right = rows.select("tree", "node", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), "c", "many", "v", F.lit(False).alias("left"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, side = _matrix(pdf["v"], dim), pdf["left"].to_numpy(bool)
        ids = pdf["c"].to_numpy()
        unit, l, r = _unit(x), np.nonzero(side)[0], np.nonzero(~side)[0]
        found = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(l), 500):
            i, j = np.nonzero(unit[l[lo : lo + 500]] @ unit[r].T >= threshold - 1e-9)
            i, j = l[i + lo], r[j]
            some = ids[i] != ids[j]
            i, j = i[some], j[some]
            found.append(np.stack([i, j], 1)[_cosines(x[i], x[j]) >= threshold])
        return _told(np.concatenate(found), pdf)

    return left.unionByName(right).groupBy("tree", "node", "i", "j").applyInPandas(compare, _LINKS)
