"""Each stage of the pipeline on all its predecessor kept, against brute force."""

from collections import Counter

import corpus_pipeline as pipeline
from spanloom.llm import mixing, quality

from .helpers import edge_docs, empty_docs
from .test_search import least_reachable, word_sets


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    (_, good), (_, exact), (_, near), (_, mix), (_, pack) = pipeline.STAGES
    first = good(spark, docs, sf_dir).cache()
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    second = exact(spark, first, sf_dir).cache()
    keep = {}
    for r in first.collect():
        keep[r["text"]] = max(r["doc_id"], keep.get(r["text"], -1))
    assert {r["doc_id"] for r in second.collect()} == set(keep.values())
    third = near(spark, second, sf_dir).cache()
    rows = second.collect()
    sets = {r["doc_id"]: word_sets(r["text"], 5) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = least_reachable(sets, links)
    assert {r["doc_id"] for r in third.collect()} == {d for d in sets if roots[d] == d}
    fourth = mix(spark, third, sf_dir).cache()
    assert fourth.columns == docs.columns
    assert set(Counter(r["doc_id"] for r in fourth.collect()).values()) <= {1, 2, 3}
    pieces = pack(spark, fourth, sf_dir).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in fourth.collect())
    bins = Counter()
    for r in pieces:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096


def test_run_gives_the_last_stage(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_edges(spark, sf_dir):
    """Each stage's rows on nulls, empty and long texts, ties and repeated rows are those of its definition."""
    (_, good), (_, exact), (_, near), (_, mix), (_, pack) = pipeline.STAGES
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    rows = sorted(map(tuple, docs.collect()), key=repr)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    assert sorted(map(tuple, good(spark, docs, sf_dir).collect()), key=repr) == [r for r in rows if model.score([r[1]])[0] >= pipeline.LEAST_QUALITY]

    kept = exact(spark, docs, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r[1] or "", []).append(-1 if r[0] is None else r[0])
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in kept) == sorted((t, max(ids)) for t, ids in by.items())

    kept = sorted(map(tuple, near(spark, docs, sf_dir).collect()), key=repr)
    assert Counter(r[0] for r in kept) == Counter([1, 2, 3, 7, 8, None, None])

    taken = Counter(map(tuple, mix(spark, docs, sf_dir).collect()))
    repeats = {(r["doc_id"], r["source"]): r["repeats"] for r in mixing.mix(docs, mixing.cycle_weights(pipeline.SOURCE_WEIGHTS)).collect()}
    assert set(taken) <= set(rows) and max(taken.values()) <= 6  # one row stands there twice
    assert all(taken[r] == repeats[r[0], r[3]] * rows.count(r) for r in set(rows) if r[0] is not None)

    pieces = pack(spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r[0] for r in rows)
    for _, function in pipeline.STAGES:
        assert function(spark, empty_docs(spark), sf_dir).count() == 0
