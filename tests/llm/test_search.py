"""Near duplicates, secrets, chat formatting and the classifier against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, common, jaccard_join, quality, queries, rp_forest, secrets
from spanloom.llm.common import connected_components, flag_keys, join_spread

from .helpers import edge_docs, empty_docs

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == least_reachable(nodes, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# n-gram Jaccard join


def word_sets(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = BLANK.findall(lower)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute_components(docs, percent=85):
    sets = {d: word_sets(t) for d, t in docs}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    roots = least_reachable(ids, links)
    return {d: (len(sets[d]), roots[d]) for d in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(i, f"new{rng.randrange(10**6)}")
        elif len(out) > 2:
            del out[i]
    return out


def near_copies(seed, sizes, copies, rate):
    rng, docs = random.Random(seed), []
    passage = [f"common{i}" for i in range(60)]
    for size in sizes:
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        for c in range(copies):
            words = edited(rng, base, int(c * rate * size / copies))
            if c % 3 == 0 and size > 100:
                words = words + passage
            docs.append((len(docs), " ".join(words)))
    return docs


def as_docs(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def jaccard(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, **options).collect()}


def test_links_of_all_sizes(spark):
    docs = near_copies(1, [*range(1, 90, 2), 120, 200, 400, 900, 2500], 7, 0.05)
    assert jaccard(as_docs(spark, docs)) == brute_components(docs)


def test_large_cluster_goes_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 40)
    monkeypatch.setattr(jaccard_join, "CENTRES", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(edited(rng, base[: 100 + i % 50], rng.randrange(6)))) for i in range(400)]
    assert jaccard(as_docs(spark, docs)) == brute_components(docs)


def test_hardly_linked_cluster_is_compared_by_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 25)
    monkeypatch.setattr(jaccard_join, "CENTRES", 1)
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(90)]
    docs = [(i, " ".join(edited(rng, base[: 70 + i % 20], rng.randrange(1, 5)))) for i in range(300)]
    want = brute_components(docs)
    assert 20 < len({c for _, c in want.values()}) < 290
    assert jaccard(as_docs(spark, docs)) == want


def shuffle_files(spark):
    """Files of shuffles that are still on this process's disk."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_shuffle_files_go_when_their_table_is_written(spark):
    before = shuffle_files(spark)
    numbers = spark.range(20_000).withColumn("k", F.col("id") % 999)
    common.stage(numbers.groupBy("k").count().join(numbers.hint("merge"), "k"), "numbers")
    for _ in range(50):  # they go by themselves, not at once
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before


def test_slices_lose_no_link(spark, monkeypatch):
    """First shingles and tiles that go over the disk in slices give what they give at once."""
    for name, value in (("TILE", 25), ("CENTRES", 1), ("FEW", 3), ("SLICE_ROWS", 400), ("SLICE_BYTES", 100_000)):
        monkeypatch.setattr(jaccard_join, name, value)
    written, stage = Counter(), jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: written.update([name]) or stage(df, name))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    docs = [(i, " ".join(edited(rng, base[: 70 + i % 20], rng.randrange(1, 5)))) for i in range(150)]
    assert jaccard(as_docs(spark, docs)) == brute_components(docs)
    assert written["jaccard-again"] > 2


def test_near_copies_go_over_the_disk_in_parts(spark, monkeypatch):
    """Neither all pairs of near copies nor all their sets are on disk at once, and no link is lost."""
    for name, value in (("SLICE_ROWS", 400), ("SLICE_BYTES", 8_000)):
        monkeypatch.setattr(jaccard_join, name, value)
    sizes, stage = {}, jaccard_join.stage

    def counted(df, name):
        out = stage(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    docs = near_copies(5, [20, 40, 60, 80, 90, 100, 110, 120], 15, 0.1)
    assert jaccard(as_docs(spark, docs)) == brute_components(docs)
    assert len(sizes["jaccard-sets"]) > 3 and max(sizes["jaccard-sets"]) < sum(sizes["jaccard-sets"]) * 0.7
    assert sum(sizes["jaccard-sets"]) == sizes["jaccard-dealt"][0] > 50
    assert len(sizes["jaccard-pairs-met"]) > 2


def test_pairs_connect_what_shares_enough(spark, monkeypatch):
    """First neighbours, then pairs across what they don't connect: the components are those of all pairs."""
    rng = random.Random(4)
    least = {k: rng.choice([1, 2, 3, 5]) for k in range(60)}
    groups = [sorted(rng.sample(range(60), rng.randrange(2, 5))) for _ in range(60)] + [[20, 30, 40], [20, 25, 40], [20, 35, 40, 50]] * 2
    groups += [sorted([*rng.sample(range(60, 70), 8), rng.randrange(60)]) for _ in range(12)]
    least |= dict.fromkeys(range(60, 70), 5)
    rows = [(i, [(k, least[k], k) for k in own]) for i, own in enumerate(groups)]
    shared = Counter((a, b) for own in groups for i, a in enumerate(own) for b in own[i + 1 :])
    want = least_reachable(range(70), [p for p, n in shared.items() if n >= min(least[p[0]], least[p[1]], 3)])
    assert 5 < len(set(want.values())) < 65
    frame = spark.createDataFrame(rows, "sig long, own array<struct<k: long, least: tinyint, m: long>>")
    for most in (1 << 25, 40):
        monkeypatch.setattr(jaccard_join, "SLICE_ROWS", most)
        got = [(r["a"], r["b"]) for r in jaccard_join._pairs(frame).collect()]
        assert all(shared[tuple(sorted(p))] >= min(least[p[0]], least[p[1]], 3) for p in got)
        assert least_reachable(range(70), got) == want


def test_documents_of_one_template_do_not_meet(spark):
    """Jaccard 0.6 through a shared form: common shingles come last, so that no class has them among its first."""
    rng = random.Random(12)
    form = [f"form{i}" for i in range(160)]
    rows = [(i, " ".join(form + [f"own{rng.randrange(10**9)}" for _ in range(50)])) for i in range(3000)]
    docs = jaccard_join._read(as_docs(spark, rows), "doc_id", "text")
    counts = jaccard_join.sketch(jaccard_join.classes(docs, 4))
    assert counts.sum() == sum(len(t.split()) - 3 for _, t in rows)
    assert jaccard_join.meetings(docs, counts, 4, 85).count() == 0


def test_common_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    docs = near_copies(8, [8, 15, 30, 70, 90, 150, 300, 800], 12, 0.1)
    assert jaccard(as_docs(spark, docs)) == brute_components(docs)


def test_a_full_sketch_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLOTS", 8)
    docs = near_copies(9, [8, 15, 30, 70, 150, 300], 8, 0.1)
    assert jaccard(as_docs(spark, docs)) == brute_components(docs)


def test_many_sketches_add_up(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAN", 2)
    docs = jaccard_join._read(as_docs(spark, near_copies(2, [50, 90], 9, 0.1)).repartition(7), "doc_id", "text")
    rows = jaccard_join.classes(docs, 4)
    assert jaccard_join.sketch(rows).sum() == rows.where("n > 0").agg(F.sum("n")).first()[0]


def test_words_that_defeat_polynomial_hashes_stay_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    docs = [(1, one), (2, other), (3, f"x {one} y z"), (4, f"x {other} y z"), (5, " ".join([one] * 9)), (6, " ".join([other] * 9)), (7, one)]
    assert jaccard(as_docs(spark, docs)) == {**brute_components(docs)}
    assert jaccard(as_docs(spark, docs))[2] == (1, 2) and jaccard(as_docs(spark, docs))[7] == (1, 1)


def near_rows(df, **options):
    return sorted((tuple(r) for r in jaccard_join.drop_near_copies(df, **options).collect()), key=repr)


def test_rows_that_repeat_an_id_go_by_their_own_text(spark):
    rng = random.Random(7)
    a = [f"a{rng.randrange(10**6)}" for _ in range(80)]
    copy, other = " ".join([*a[:79], "new"]), " ".join(f"b{rng.randrange(10**6)}" for _ in range(80))
    df = as_docs(spark, [(3, " ".join(a)), (7, copy), (7, other), (None, copy + " more"), (None, other + " more"), (None, "alone without an id")])
    assert near_rows(df, words=5, percent=80) == sorted([(3, " ".join(a)), (7, other), (None, "alone without an id")], key=repr)
    twice = as_docs(spark, [(7, copy), (7, " ".join(a)), (7, copy), (1, ""), (1, ""), (None, None)])
    kept = near_rows(twice, words=5, percent=80)
    assert len(kept) == 4 and {t for _, t in kept} - {copy, " ".join(a)} == {"", None}
    nobody = as_docs(spark, [(None, " ".join(a)), (None, copy)])
    assert len(near_rows(nobody, words=5, percent=80)) == 1


def test_short_copies_with_a_common_start(spark):
    start = "one two three four five six"
    docs = [(1, f"{start} a b"), (2, f"{start} a b c")] + [(i, f"{start} x{i} y{i}") for i in range(10, 60)]
    kept = {r["doc_id"] for r in jaccard_join.drop_near_copies(as_docs(spark, docs), words=5, percent=80).collect()}
    assert kept == {1, *range(10, 60)}
    pair = [(1, "a b c"), (2, "a b c d")]  # two shingles of three
    assert {i: c for i, (_, c) in jaccard(as_docs(spark, pair), words=2, percent=60).items()} == {1: 1, 2: 1}


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert jaccard(docs) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_linked_sets_share_first_shingles():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(np.exp(rng.uniform(np.log(5), np.log(3000))))
        counts = rng.integers(0, 3, jaccard_join.SLOTS)
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        d = int(rng.integers(0, max(2, int(0.17 * n))))
        gone = int(rng.integers(0, d + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, d - gone, dtype=np.uint64)]))
        if jaccard_join._links(a, b, 85) and not np.array_equal(a, b):
            (x, k), (y, m) = (jaccard_join.first_shingles(s, counts) for s in (a, b))
            assert len(set(x) & set(y)) >= max(k, m), (len(a), len(b))
            assert jaccard_join._linkable(len(a), 85) and jaccard_join._linkable(len(b), 85)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(23)]  # 20 shingles; one more word at the end adds one each
    docs = [(1, " ".join(words)), (2, " ".join(words + ["a", "b", "c"])), (3, " ".join(["q"] + words + ["x", "y", "z"]))]
    assert jaccard(as_docs(spark, docs)) == brute_components(docs)


def test_jaccard_edges(spark):
    docs = edge_docs(spark)
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert got == want
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert jaccard_join.jaccard_components(empty_docs(spark)).count() == 0
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 0, 1, 2, 3, 7, 8]  # 6 repeats the words of 3, and of 7 one row is enough
    assert jaccard_join.drop_near_copies(empty_docs(spark)).count() == 0


def test_keys_that_may_be_there(spark):
    rows = spark.range(20000).withColumn("key", F.when(F.col("id") % 7 != 0, F.col("id") * 1_000_003))
    keys = spark.range(0, 20000, 10).select((F.col("id") * 1_000_003).alias("k"))
    got = {r["id"]: r["flag"] for r in flag_keys(rows, "key", keys, "flag").collect()}
    assert len(got) == 20000 and all(got[i] for i in range(0, 20000, 10) if i % 7) and not any(got[i] for i in range(0, 20000, 7))
    assert sum(got.values()) < 2000
    assert not flag_keys(rows, "key", keys.limit(0), "flag").where("flag").count()


def test_a_full_filter_flags_all(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(common, "KEY_BITS", 1)
    rows = spark.range(300000)
    got = flag_keys(rows, "id", rows.where("id % 2 = 0"), "flag").groupBy("flag", F.col("id") % 2).count().collect()
    assert {(r["flag"], r[1]) for r in got} == {(True, 0), (True, 1), (False, 1)} or all(r["flag"] for r in got)
    assert sum(r["count"] for r in got if r["flag"]) > 290000


def test_rows_of_a_hot_key_meet_their_group(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 > 0, F.lit(5)).when(F.col("id") % 100 > 0, F.col("id")).alias("key"))
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("many"), F.max("id").alias("top"))
    got = {r["id"]: r["top"] for r in join_spread(rows, groups, "key", "many").collect()}
    assert got == {i: 8999 if i % 3 else i if i % 100 else None for i in range(9000)}


# embeddings


def brute_vectors(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold]
    roots = least_reachable([i for i, _ in rows], links)
    return {i: (sum(i in x for x in links), roots[i]) for i, _ in rows}


def test_driver_vectors(spark, sf_dir):
    """Splits and several trees at 500 vectors too."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert rp_forest._levels(len(rows), rp_forest.LEAF) >= 2
    check_recall(rp_forest.near_duplicates(df).collect(), rows, 0.95)


def check_recall(found, rows, least, threshold=0.9):
    """No link too many, few too few, and components that follow from those found."""
    want = brute_vectors(rows, threshold)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] and got[i][2] == (got[i][1] == i) for i in want)
    true = sum(n for n, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= least * true
    return true


def scattered_pairs(n, seed):
    """Vectors in pairs of which some two in five link."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 2, 64))
    return np.concatenate([base, base + 0.5 * rng.uniform(0.5, 1.1, size=(n // 2, 1)) * rng.normal(size=base.shape)])


def as_vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def brute_counts(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(u[i : i + 500] @ u.T >= threshold).sum(1) for i in range(0, len(u), 500)]) - 1


def test_recall_of_the_forest(spark):
    x = scattered_pairs(6000, 2)
    want = brute_counts(x)
    assert rp_forest._levels(len(x), rp_forest.LEAF) == 6 and want.sum() > 1000
    got = {r["vec_id"]: r["n_links"] for r in rp_forest.near_duplicates(as_vectors(spark, x)).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_nodes_are_fitted_again(spark, monkeypatch):
    """With a sample that reaches three levels, the others are fitted node by node, in rounds."""
    monkeypatch.setattr(rp_forest, "MAX_SAMPLE", 256)
    monkeypatch.setattr(rp_forest, "MORE_LEVELS", 2)
    monkeypatch.setattr(rp_forest, "DEALT", 150)
    x = scattered_pairs(3000, 4)
    want = brute_counts(x)
    got = {r["vec_id"]: r["n_links"] for r in rp_forest.near_duplicates(as_vectors(spark, x), leaf=32, trees=6).collect()}
    assert len(got) == 3000 and all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.95 * want.sum()


def test_trees_in_waves_lose_no_link(spark, monkeypatch):
    """Parts of trees, one after the other, find what all trees find at once, and none sends many copies of the table."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 12)).astype(np.float32).astype(float)
    x[350:] = (x[:350] + 0.2 * rng.normal(size=(350, 12))).astype(np.float32)
    x[1] += 1e-12  # needs double precision
    assert (rp_forest._matrix(rp_forest.pd.Series(rp_forest._packed(x)), 12) == x).all()
    tell = lambda: {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rp_forest.near_duplicates(as_vectors(spark, x), leaf=90, trees=2).collect()}
    at_once = tell()
    written, stage = Counter(), common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: written.update([name]) or stage(df, name))
    monkeypatch.setattr(rp_forest, "WAVE_BYTES", 1 << 10)
    assert tell() == at_once and sum(n for n, _ in at_once.values()) > 300
    assert written["forest-wave"] >= 4


def test_waves_hold_every_node_once():
    for n in (10, 50_000, 600_000, 15_000_000):
        waves = rp_forest._waves(n, 64, rp_forest._levels(n, 128), 10, 8)
        assert sorted((t, part / 2**level) for own, part, level in waves for t in own) == sorted((t, part / 2 ** waves[0][2]) for t in range(8) for part in range(2 ** waves[0][2]))
        sent = n * 296 * 1.14 ** rp_forest._levels(n, 128) * len(waves[0][0]) / 2 ** waves[0][2]
        assert sent <= max(1 << 28, 256 * n)


def test_nodes_that_no_split_makes_smaller(spark, monkeypatch):
    """Parallel vectors fall on one place in every direction; what stays large is compared in blocks."""
    monkeypatch.setattr(rp_forest, "MAX_SAMPLE", 64)
    monkeypatch.setattr(rp_forest, "ROUNDS", 1)
    monkeypatch.setattr(rp_forest, "DENSE", 10**6)
    monkeypatch.setattr(rp_forest, "TILE", 40)
    rng = np.random.default_rng(1)
    one = rng.normal(size=8)
    scale = 2.0 ** np.arange(-100, 100)[:, None]  # by powers of two, so that not a bit of their directions differs
    x = np.concatenate([scale * one, -scale * one])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rp_forest.near_duplicates(as_vectors(spark, x), leaf=16, trees=2).collect()}
    assert got == {i: (199, 0 if i < 200 else 200) for i in range(400)}


def test_links_in_a_dense_group_are_whole(spark):
    rng = np.random.default_rng(8)
    near = rng.normal(size=64) + 0.27 * rng.normal(size=(700, 64))
    x = np.concatenate([near, rng.normal(size=(1300, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rp_forest.near_duplicates(df, leaf=100).collect()}
    assert want[:700].sum() > 400_000
    assert [got[i][0] for i in range(2000)] == want.tolist()
    assert {got[i][1] for i in range(700) if want[i]} == {0}


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.95, 0.1]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS c", "2 AS v", "3 AS many")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rp_forest.near_duplicates(df).collect()}
    want = brute_vectors([(i, [float(np.float32(x)) if x is not None else None for x in v] if v else v) for i, v in rows])
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    again = {r["vec_id"]: r["n_links"] for r in rp_forest.near_duplicates(df.unionByName(df), leaf=2).collect()}
    assert [again[i] for i in (1, 4, 10, 12)] == [7, 0, 1, 1]  # rows that repeat an id and a vector link with each other
    more = df.limit(1).selectExpr("CAST(NULL AS BIGINT) AS vec_id", "embedding")
    assert [tuple(r) for r in rp_forest.near_duplicates(more).collect()] == [(None, 0, None, False)]
    assert rp_forest.near_duplicates(df.limit(0)).count() == 0


def test_control_strings_split_over_parts(spark):
    """However a text is cut into parts, and whatever stands between, it is formatted as the whole, and nothing is forged."""
    rng = random.Random(5)
    bits = ["<|end|>", "<|turn|>", "<|body|>", "<\\|end|>", "[INST]", "</s>", "<<SYS>>", "<|image|>", "a", "<", "|", ">", "\\", "é"]
    rows, texts = [], []
    for c in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(4)))
        parts = [("text", text[a:b], None, None) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(c, 0, "user", parts), (c, 1, "assistant", [("text", text, None, None)]), (c, 2, "user", [*parts, ("image", None, "r", 3), *parts])]
        texts.append(text)
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for r in chat.format_turns(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), "loss", "formatted", "attachments").collect():
        text = texts[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == [("user", text), ("assistant", text), ("user", text + "<|image|>" + text)]
        assert r["formatted"].count("<|end|>") == 3 and r["formatted"].count("<|turn|>") == 3 and r["formatted"].count("<|image|>") == 1


def test_chat_edges(spark):
    long = "<|end|>" * 30000
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "b"), (None, None, "assistant", "c"), (2, 0, None, None), (3, 0, "assistant", long), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text"))).selectExpr("*", "1 AS body", "2 AS whole", "3 AS loss")
    got = {r["conv_id"]: r for r in chat.format_turns(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a")] * 2
    assert [tuple(t) for t in got[None]["turns"]] == [("assistant", "c"), ("user", "b")] and got[None]["learned"] == "c"
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")]
    assert [tuple(t) for t in got[3]["turns"]] == [("assistant", ""), ("assistant", long)] and got[3]["learned"] == long


# quality


def test_long_runs_are_read_to_their_end():
    shapes, vectors = {"\nother": 0, "A": 1, "a": 2}, np.eye(3)
    x = quality.pool(["A" * 64 + "a" * 200, "A" * 64, "A" * 264 + " b"], {}, shapes, vectors)[:, 3:6]
    assert x[0, 2] > 0.5 and x[1].tolist() == [0, 1, 0] and x[2, 1] > 0.9
    assert "".join(quality._tokens("Ab0-" * 50)) == "Ab0-" * 50


def test_words_differ_to_their_last_letter():
    assert quality.shape_of("a1" * 30 + "-") != quality.shape_of("a1" * 30 + "+") and len(quality.shape_of("a1" * 30)) == 60


def test_scores_against_plain_pooling(spark, sf_dir):
    """Every document's score from vectors summed token by token."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    dim = model.vectors.shape[1]
    for r in docs.collect():
        tokens = quality._tokens(r["text"])
        rows = [(model.words.get(t), model.shapes.get(quality.shape_of(t), model.shapes["\nother"])) for t in tokens]
        x = np.zeros(2 * dim + 3)
        for word, shape in rows:
            x[:dim] += model.vectors[shape if word is None else word] / len(rows)
            x[dim:-3] += model.vectors[shape] / len(rows)
        pairs = [(shape if word is None else word, shape) for word, shape in rows]
        x[-3:] = sum(a == b for a, b in zip(pairs, pairs[1:])) / max(1, len(rows) - 1), len(set(pairs)) / max(1, len(rows)), np.log1p(len(rows))
        a, b, c, d = model.layers
        z = np.maximum((x - model.mean) / model.scale @ a + b, 0) @ c + d
        assert abs(1 / (1 + np.exp(-z / model.temperature)) - got[r["doc_id"]]) < 1e-4


def test_the_sample_keeps_its_bounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels, seed: seen.append(texts))
    docs = spark.createDataFrame([(i, "x" * (100_000 if i == 3 else 50)) for i in range(400)], "doc_id long, text string")
    quality.fit(docs, docs.selectExpr("doc_id", "doc_id % 2 AS quality"), max_rows=100, max_bytes=3000)
    assert 20 <= len(seen[0]) <= 60 and sum(map(len, seen[0])) <= 3000


# secrets


def brute_spans(text, rule):
    pattern = rule.pattern.replace("(?i)", "")
    flags = re.ASCII | (re.IGNORECASE if rule.pattern.startswith("(?i)") else 0)
    return [m.span() for m in re.finditer(pattern, text, flags) if len(m[rule.group]) >= rule.least]


def test_trigrams_are_mandatory():
    for rule, text in ((secrets.BASE[0], "API_KEY = abcdef"), (secrets.BASE[0], "apikey:'abcdef'"), (secrets.BASE[1], "AKIA" + "A" * 16), (secrets.EXTRA[0], "-----BEGIN RSA PRIVATE KEY-----"), (secrets.EXTRA[1], "ghp_" + "a" * 36)):
        query = secrets.trigram_query(rule.pattern)
        assert query and all(any(all(t in text.lower() for t in s) for s in clause) for clause in query)
        assert re.search(rule.pattern, text)
    assert secrets.trigram_query(secrets.BASE[2].pattern) == []
    assert secrets.trigram_query("ab|cde") == []
    assert secrets.trigram_query("(abcd|xyz)[0-9]+tail") == [[frozenset({"abc", "bcd"}), frozenset({"xyz"})], [frozenset({"tai", "ail"})]]


def test_spans_against_brute_force(spark):
    rng = random.Random(9)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "API", "=", ":", ' "', "' ", " ", "abcdef", "x", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "\U0001f600", "é", "\n", "ghp_" + "a1" * 18, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "secret=token:abcdefgh", "eyJhbGciOiJI.eyJzdWIiOiIx.abc", "K"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)]
    found = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in secrets.scan(as_docs(spark, rows)).collect()}
    rules = secrets.BASE + secrets.EXTRA
    for i, text in rows:
        want = sorted((a, k, b) for k, rule in enumerate(rules) for a, b in brute_spans(text, rule))
        assert found[i] == want, text
    assert sum(map(len, found.values())) > 100


def test_secret_edges(spark):
    docs = edge_docs(spark).selectExpr("*", "1 AS key", "2 AS rules")
    rows = secrets.scan(docs).collect()
    assert len(rows) == docs.count() and not any(r["found"] for r in rows)
    assert secrets.scan(empty_docs(spark)).count() == 0
    assert secrets.scan(docs, secrets.BASE[2:]).count() == docs.count()


# chat


def test_turns_come_back(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|turn|>user<|body|>", "<\\|end|>", "<\\\\|end|>\\", "<<SYS>>x<</SYS>>", "<", "|end|>", "<|", None, "", "é\U0001f600<|x", "[[INST]<s>", "\\"]
    rows = [(c, t, r, tricky[(c + t) % len(tricky)]) for c in range(20) for t, r in enumerate(["system", "user", "assistant", "us<|body|>er", None, "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    done = chat.format_turns(df)
    got = done.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"), "formatted").collect()
    for r in got:
        own = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["learned"] == "".join(t for role, t in own if role == "assistant")
        assert r["formatted"].count("<|end|>") == 6 and "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]


def test_parts_and_attachments(spark):
    parts = "[{'kind':'text','text':'see <|image|>'},{'kind':'image','ref':'a.png','tokens':256},{'kind':'audio','ref':'b.wav','tokens':90},{'kind':'text','text':' end'},{'kind':'document','ref':'c.pdf'},{'kind':'film','ref':'d'}]"
    df = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role").withColumn("parts", F.from_json(F.lit(parts.replace("'", '"')), f"array<{chat.PART}>"))
    more = spark.sql(f"SELECT 1L AS conv_id, 1L AS turn, 'assistant' AS role, CAST(NULL AS array<{chat.PART}>) AS parts")
    r = chat.format_turns(df.unionByName(more), text_tokens=F.length).collect()
    assert len(r) == 1
    r = r[0]
    assert r["formatted"] == "<|turn|>user<|body|>see <\\|image|><|image|><|audio|> end<|document|><|document|><|end|><|turn|>assistant<|body|><|end|>"
    assert [(a["index"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 90), (2, "document", "c.pdf", 0), (3, "film", "d", 0)]
    assert r["tokens"] == 346 + len("see <\\|image|><|image|><|audio|> end<|document|><|document|>")
    assert [tuple(s) for s in r["loss"]] == [(len(r["formatted"]) - len("<|end|>"), 0)]
    assert chat.format_turns(df.limit(0)).count() == 0


# quality


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2


def test_classifier_edges(spark):
    docs = edge_docs(spark).selectExpr("*", "1 AS score", "2 AS quality")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (6, 1), (7, 0), (5, 0), (2, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(empty_docs(spark), labels).count() == 0
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, quality.classify(docs.repartition(3), labels).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf_dir, name):
    import os

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]}) q").fetchall(), key=repr)
    assert got == want


def test_digest_of_the_control_conversation(spark, sf_dir):
    text = "</s>[INST] ok [/INST]"
    r = queries.op6_chat(spark, sf_dir).where("conv_id = -1").first()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
