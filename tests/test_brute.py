"""Queries that have no SQL twin, against plain Python over their whole tables."""

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import fuzzy, segment
from spanloom.operators import represent as M


def rows_of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def run(spark, sf_dir, name):
    return catalog.queries()[name](spark, sf_dir).collect()


def turns(spark, sf_dir):
    return {(r["conv_id"], r["turn"]): r["text"] or "" for r in rows_of(spark, sf_dir, "conversations")}


def sentences(text):
    """Cut before enumerations and after ends of sentences, sign by sign."""
    starts = {m.start() for m in re.finditer(r"\b\d+\)\s+", text)} | {m.end() for m in re.finditer(r"[.!?]+(?:\s+|$)", text)}
    out, piece, at = [], "", 0
    for i, c in enumerate(text + "\0"):
        if i in starts or i == len(text):
            if piece.strip():
                left = at + len(piece) - len(piece.lstrip())
                out.append((left, left + len(piece.strip())))
            piece, at = "", i
        piece += c
    return out or [(0, len(text))]


def test_sentence_spans(spark, sf_dir):
    got = defaultdict(list)
    for r in sorted(run(spark, sf_dir, "sentence_spans")):
        got[r["conv_id"], r["turn"]].append((r["start"], r["end"]))
    assert dict(got) == {k: sentences(t) for k, t in turns(spark, sf_dir).items()}


def test_segments_cover_their_sentences(spark, sf_dir):
    """Clauses in order make up their sentence, and ids say where they stand; the tree holds the same clauses."""
    got = {r["subsentence_id"]: r["subsentence"] for r in run(spark, sf_dir, "segmented_messages")}
    want = {}
    for (conv, turn), text in turns(spark, sf_dir).items():
        for i, (a, b) in enumerate(sentences(text) if text.strip() else []):
            own = [got[k] for j in range(len(text)) if (k := f"{conv}-{turn}_{i}_{j}") in got]
            assert re.sub(r"\s+", "", "".join(own)) == re.sub(r"\s+", "", text[a:b])
            want |= {f"{conv}-{turn}_{i}_{j}": x for j, x in enumerate(own)}
    assert got == want
    parent = lambda k: k.rsplit("_", 1)[0]
    tree = sorted((r["source"], r["target"]) for r in run(spark, sf_dir, "message_tree"))
    assert tree == sorted({(parent(k), k) for k in want} | {(parent(parent(k)), parent(k)) for k in want})


def test_greedy_intervals(spark, sf_dir):
    kinds = list(segment.CHUNK_PRIORITY)
    own = defaultdict(list)
    for r in rows_of(spark, sf_dir, "lineitem"):
        n = r["l_linenumber"]
        own[r["l_orderkey"]].append((n, n + 1 + int(r["l_quantity"]) % 3, kinds[n % 6]))
    want = Counter()
    for k, spans in own.items():
        left = list(spans)
        while left:  # the best of what is left, then all that doesn't touch it
            a, b, kind = min(left, key=lambda s: (s[0] - s[1], -segment.CHUNK_PRIORITY[s[2]], s[0]))
            want[k, a, b, kind] += 1
            left = [s for s in left if s[1] <= a or s[0] >= b]
    assert Counter((r["l_orderkey"], r["start"], r["end"], r["type"]) for r in run(spark, sf_dir, "greedy_intervals")) == want


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_fuzzy_matches(spark, sf_dir):
    texts = turns(spark, sf_dir)
    by_conv = defaultdict(list)
    for (conv, turn), t in sorted(texts.items()):
        by_conv[conv].append((turn, t))
    few = set(sorted(by_conv)[:25])
    want = {}
    for (conv, turn), t in texts.items():
        if conv in few:
            for pos, (a, b) in enumerate(sentences(t)):
                score, at = max((ratio(t[a:b], c), -k) for k, c in by_conv[conv])
                if score >= 0.6:
                    want[f"{conv}-{turn}-{pos}"] = (-at, pytest.approx(score))
    got = {r["query_id"]: (r["cand_id"], r["score"]) for r in run(spark, sf_dir, "best_fuzzy_matches") if int(r["query_id"].rsplit("-", 2)[0]) in few}
    assert got == want and want


def test_codebook_matches(spark, sf_dir):
    parts = rows_of(spark, sf_dir, "part")
    entries, labels = {r["p_type"].lower() for r in parts}, {r["p_name"] for r in parts}
    got = {r["label"]: (r["match"], r["score"]) for r in run(spark, sf_dir, "codebook_fuzzy_matches")}
    for x in labels:
        best = max(ratio(x, e) for e in entries)
        assert (x in got) == (best >= 0.6)
        if x in got:
            assert got[x][1] == pytest.approx(best) and ratio(x, got[x][0]) == pytest.approx(best)


def test_span_positions(spark, sf_dir):
    """Every passage in every document, whatever it is keyed by."""
    docs, passages = rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "benchmark")
    want = {(d["doc_id"], p["item_id"]): at for d in docs for p in passages if d["text"] and p["text"] and (at := fuzzy.locate(p["text"], d["text"]))}
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in run(spark, sf_dir, "span_positions")}
    assert got == want and want
    shares = {r["relation"]: r["count"] for r in run(spark, sf_dir, "span_relation_shares") if r["count"]}
    assert shares == Counter(r["relation"] for r in run(spark, sf_dir, "span_positions"))


def test_capped_sample(spark, sf_dir):
    parts = {r["p_partkey"]: set(r["p_name"].split(" ")) for r in rows_of(spark, sf_dir, "part")}
    freq = Counter(x for s in parts.values() for x in s)
    count, taken, order, want = Counter(), set(), sorted(freq, key=lambda x: (-freq[x], x)), []
    for number in range(len(parts)):
        for label in order:
            unit = next((i for i in sorted(parts) if i not in taken and label in parts[i]), None) if count[label] < 20 else None
            if unit is not None:
                taken.add(unit)
                count.update(parts[unit])
                want.append((unit, label, number))
    assert sorted(tuple(r) for r in run(spark, sf_dir, "capped_sample")) == sorted(want)


def blobs(spark, sizes, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = 6 * np.eye(4)[: len(sizes)]
    points = [(c + spread * rng.normal(size=4), f"l{k}") for k, (n, c) in enumerate(zip(sizes, centres)) for _ in range(n)]
    return spark.createDataFrame([(i, x.tolist(), y) for i, (x, y) in enumerate(points)], "id long, vector array<double>, label string"), points


def test_kmeans_ends_where_no_point_moves(spark):
    df, points = blobs(spark, [60, 40, 30], 0.8)
    got = {r["id"]: r["cluster"] for r in M.kmeans(df.select("id", "vector"), 3).collect()}
    x = np.array([p for p, _ in points])
    means = {c: x[[i for i in got if got[i] == c]].mean(0) for c in set(got.values())}
    assert all(min(means, key=lambda c: np.linalg.norm(x[i] - means[c])) == got[i] for i in got)
    assert len({(points[i][1], c) for i, c in got.items()}) == 3


@pytest.mark.parametrize("make", [lambda df: M.weighted_logistic(df), lambda df: M.mlp(df, [8])])
def test_models_tell_blobs_apart(spark, make):
    df, points = blobs(spark, [60, 40, 30], 0.8)
    model, names = make(df)
    rows = M.predict(model, names, df).collect()
    assert len(rows) == len(points) and all(r["true_label"] == r["pred_label"] == points[r["id"]][1] for r in rows)


def test_weights_lift_the_rare_class(spark):
    """On overlapping classes of 400 and 20, weights put the border between the centres, not beside the small one."""
    df, _ = blobs(spark, [400, 20], 4.0, seed=3)
    model, names = M.weighted_logistic(df)
    hits = Counter(r["true_label"] for r in M.predict(model, names, df).collect() if r["true_label"] == r["pred_label"])
    assert hits["l1"] >= 14 and hits["l0"] >= 280


def test_graph_metrics_of_paths_and_rings(spark, sf_dir):
    """Distances by powers of the adjacency matrix, eigenvalues by their closed forms."""
    from spanloom.operators import graphs as G

    edges = [("p", str(i), str(i + 1)) for i in range(5)] + [("r", str(i), str((i + 1) % 6)) for i in range(6)]
    nodes = spark.createDataFrame([(g, str(i), "x") for g in "pr" for i in range(6)], "graph_id string, id string, label string")
    e = spark.createDataFrame([(g, a, b, "n", 1.0) for g, a, b in edges], "graph_id string, source string, target string, label string, weight double")
    got = {r["graph_id"]: r for r in G.metrics(nodes, e).collect()}
    for g, values in (("p", [2 - 2 * np.cos(np.pi * k / 6) for k in range(6)]), ("r", [2 - 2 * np.cos(2 * np.pi * k / 6) for k in range(6)])):
        a = np.zeros((6, 6))
        for h, x, y in edges:
            if h == g:
                a[int(x), int(y)] = a[int(y), int(x)] = 1
        reach, power = np.full((6, 6), 99), np.eye(6)
        for k in range(6):
            reach[(power > 0) & (reach == 99)] = k
            power = power @ a
        far = reach[~np.eye(6, dtype=bool)]
        share = np.array([v for v in values if v > 1e-9]) / sum(values)
        assert got[g]["diameter"] == far.max() and got[g]["aspl"] == pytest.approx(far.mean())
        assert got[g]["spectral_entropy"] == pytest.approx(-(share * np.log2(share)).sum())
        assert got[g]["unique_eigenvalues"] == len(set(np.round(values, 8)))
    summary = {r["metric"]: r for r in catalog.queries()["graph_summary"](spark, sf_dir).collect()}
    metrics = catalog.queries()["graph_metrics"](spark, sf_dir)
    for name in ("diameter", "aspl"):
        one = metrics.agg(F.avg(name).alias("m"), F.stddev_samp(name).alias("s")).first()
        assert summary[name]["mean"] == pytest.approx(one["m"]) and summary[name]["std"] == pytest.approx(one["s"] or 0.0)


def test_phrases_lie_in_their_clauses(spark, sf_dir):
    found = defaultdict(list)
    for r in run(spark, sf_dir, "clause_phrases"):
        assert r["clause_start"] <= r["start"] < r["end"] <= r["clause_end"] and r["type"] in segment.CHUNK_PRIORITY
        found[r["conv_id"], r["turn"], r["clause_no"]].append((r["start"], r["end"]))
    for spans in found.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert {r["type"] for r in run(spark, sf_dir, "clause_phrases")} >= {"NP", "VP", "PP"}
