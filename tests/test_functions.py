"""Procedural functions and edge cases of the operators."""

import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import fuzzy, numbers, segment, text
from spanloom.functions.segment import Token
from spanloom.operators import align, distributions, graphs, hierarchy, labels, neighbours, phrases, relations, represent, sampling, spans
from spanloom.sources import readers, writers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# numbers


@given(st.lists(st.integers(-50, 50), min_size=4, max_size=40))
@settings(max_examples=15, deadline=None)
def test_exclusive_quartiles(spark, values):
    df = frame(spark, [(v,) for v in values], "v long")
    q = statistics.quantiles(values, n=4)
    assert df.agg(numbers.exclusive_iqr(F.collect_list("v")).alias("x")).first()[0] == pytest.approx(q[2] - q[0])
    assert spans.exact_quartiles(df, "v", []).first()["iqr"] == pytest.approx(q[2] - q[0])


def test_quartiles_need_four(spark):
    df = frame(spark, [(1,), (2,), (3,)], "v long")
    assert spans.length_stats(df, "v").first()["iqr"] is None


# Counts of a known distribution and its published metrics.
KNOWN = [205, 176, 174, 162, 153, 115, 100, 25, 7, 6]


def test_imbalance_of_a_known_distribution(spark):
    r = distributions.imbalance(frame(spark, [(f"x{i}", c) for i, c in enumerate(KNOWN)], "label string, count long")).first()
    assert (r["k"], r["total"]) == (10, 1123)
    for name, value in {"ir_max": 34.166667, "cv": 0.634377, "gini": 0.859757, "n_eff": 7.130461, "h_norm": 0.883249}.items():
        assert r[name] == pytest.approx(value, abs=1e-6)
    one = distributions.imbalance(frame(spark, [("x", 5)], "label string, count long")).first()
    assert one["h_norm"] == 0 and one["n_eff"] == 1
    none = distributions.imbalance(frame(spark, [], "label string, count long")).first()
    assert none["total"] == 0 and none["gini"] is None and none["h_norm"] is None


# text


def test_normal_forms(spark):
    df = frame(spark, [("  Call at 10:30 am on 12/24/2024 or 2024-12-24, 2.5 Times ",)], "t string")
    r = df.select(text.normalize_phrase(F.col("t")).alias("a"), text.codebook_id(F.lit(" a  b ")).alias("b"), text.label_norm(F.lit("Care-Coordination & X")).alias("c"), text.label_alias(F.lit("economicstability")).alias("d")).first()
    assert r["a"] == "call at <time> on <date> or <date>, <num> times"
    assert (r["b"], r["c"], r["d"]) == ("a_b", "care_coordination_and_x", "economic_stability")


def test_markdown(spark):
    source = "# Title\n\n> quote\n* one\n2. two\n**bold** and _it_ `code` [link](http://x) ![pic](y)\n```\nfence\n```\n---\n"
    out = frame(spark, [(source,)], "t string").select(text.strip_markdown(F.col("t"))).first()[0]
    assert "Title" in out and "#" not in out and "bold and it code link pic" in out and "fence" not in out and "- one" in out and "- two" in out


def test_small_text_functions(spark):
    df = frame(spark, [("A dog, and cats; Is it? No",)], "t string")
    r = df.select(text.mini_chunks(F.col("t")).alias("c"), text.has_cue(F.lit("Also"), "elaboration").alias("cue"), text.prefixed_label(F.lit("1_2 : a:b")).alias("p"), text.prefixed_label(F.lit("none")).alias("n"), text.char_ngrams(F.lit(""), 3).alias("g")).first()
    assert [tuple(x) for x in r["c"]] == [("A dog", "NP"), ("cats", "NP"), ("Is it? No", "NP")]
    assert r["cue"] is True and tuple(r["p"]) == ("1_2", "a:b") and r["n"] is None and r["g"] == []


# fuzzy and segments


def test_ratio_depends_on_order(spark):
    assert fuzzy.ratio("tide", "diet") == 0.25 and fuzzy.ratio("diet", "tide") == 0.5
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randrange(12))), "".join(rng.choice("abc ") for _ in range(rng.randrange(12)))) for _ in range(300)]
    rows = frame(spark, pairs, "a string, b string").select("a", "b", fuzzy.could_reach(F.col("a"), F.col("b"), 0.6).alias("can"), fuzzy.ratio_udf("a", "b").alias("r")).collect()
    assert all(r["can"] or r["r"] < 0.6 for r in rows)
    assert all(r["r"] == fuzzy.ratio(r["a"], r["b"]) for r in rows)


def test_locate():
    assert fuzzy.locate("b c", "a b c d") == (2, 5)
    assert fuzzy.locate("Hello, world", "so hello world!") == (2, 14)
    assert fuzzy.locate("absent", "text") is None and fuzzy.locate(None, "x") is None


def test_sentence_spans():
    t = "First one. Second!  1) item two 2) item three"
    assert [t[a:b] for a, b in segment.sentence_spans(t)] == ["First one.", "Second!", "1) item two", "2) item three"]
    assert segment.sentence_spans("") == [(0, 0)] and segment.sentence_spans(None) == [(0, 0)]


def test_relations_and_containers(spark):
    sents = "array(named_struct('start', 0, 'end', 10), named_struct('start', 11, 'end', 20))"
    rows = frame(spark, [(0, 10), (2, 5), (8, 13), (30, 31), (11, 20)], "start int, end int").selectExpr("named_struct('start', start, 'end', end) AS s", f"{sents} AS x")
    got = rows.select(segment.relation(F.col("s"), F.col("x")).alias("r"), segment.containing(F.col("s"), F.col("x")).alias("c")).collect()
    assert [r["r"] for r in got] == ["aligned", "inside", "crosses", "outside", "aligned"]
    assert [tuple(r["c"]) for r in got] == [(0, 10), (0, 10), (0, 10), (0, 10), (11, 20)]


def test_clause_lengths():
    words = [Token(f"w{i}", 5 * i, 5 * i + 4) for i in range(40)]
    assert segment.fit_lengths(words, []) == [(0, 40)]  # no place to split
    words[19] = Token(",", 95, 96)
    assert segment.fit_lengths(words, []) == [(0, 19), (19, 40)]
    assert segment.fit_lengths(words[:12], [1, 6]) == [(0, 6), (6, 12)]
    assert segment.fit_lengths(words[:12], [10]) == [(0, 12)]
    assert segment.clauses("we went home because it was late and cold outside today") == ["we went home", "because it was late", "and cold outside today"]
    assert segment.clauses("") == []
    assert segment.flat_clauses("a, b; c") == ["a,", "b;", "c"]


def test_chunk_spans():
    assert segment.pick_apart([(0, 3, "NP"), (2, 6, "VP"), (6, 7, "DISC"), (0, 3, "PP")]) == [(2, 6, "VP"), (6, 7, "DISC")]
    tokens = [Token("ab", 0, 2), Token("cd", 3, 5), Token("ef", 6, 8)]
    assert segment.token_range(tokens, 3, 5) == (1, 2) and segment.token_range(tokens, 4, 99) == (1, 3) and segment.token_range(tokens, 50, 60) == (2, 3)


def test_repair_and_faults():
    src = "one two. three."
    bad = {"input": src, "sentences": [
        {"text": "one two.", "start": 1, "end": 9, "clauses": [{"text": "two", "start": 0, "end": 3, "phrases": [{"type": "NP", "text": "two", "start": 0, "end": 1}, {"type": "NP", "text": "two", "start": 4, "end": 7}]}]},
        {"text": "absent", "start": 0, "end": 3, "clauses": []},
        {"text": "three.", "start": 9, "end": 15, "clauses": None}]}
    assert segment.faults(src, bad)
    fixed = segment.repair(bad)
    assert segment.faults(src, fixed) == []
    assert [(s["start"], s["end"]) for s in fixed["sentences"]] == [(0, 8), (9, 15)]
    assert fixed["sentences"][0]["clauses"][0]["phrases"] == [{"type": "NP", "text": "two", "start": 4, "end": 7}]
    assert segment.repair(None) == {"input": "", "sentences": []} and segment.faults("", None) == ["no sentences"]


def test_best_match_takes_the_first_of_ties(spark):
    q = frame(spark, [("k", "q1", "abcd"), ("k", "q2", "zzzz")], "key string, query_id string, query string")
    c = frame(spark, [("k", "b", "abce", 1), ("k", "a", "abcf", 0), ("other", "x", "abcd", 0)], "key string, cand_id string, cand string, pos int")
    assert [tuple(r) for r in align.best_matches(q, c, "key").collect()] == [("q1", "a", 0.75)]


# relations


def test_chain_takes_the_first_unused(spark):
    rows = [(0, "a", "b"), (1, "b", "c"), (2, "b", None), (3, "c", None), (4, "x", "b"), (5, "y", "zz")]
    got = relations.chains(frame(spark, rows, "pos long, context string, next string")).orderBy("chain", "step").collect()
    assert [(r["chain"], r["pos"]) for r in got] == [(0, 0), (0, 1), (0, 3), (1, 2), (2, 4), (3, 5)]


def test_argmax_first_column_and_nulls(spark):
    df = frame(spark, [(1.0, 1.0, None), (None, None, None), (None, 2.0, 3.0)], "a double, b double, c double")
    assert [(r["max_value"], r["max_column"]) for r in relations.row_argmax(df, ["a", "b", "c"]).collect()] == [(1.0, "a"), (None, None), (3.0, "c")]


def test_label_selection(spark):
    df = frame(spark, [(["x", "y"],), (["x"],), ([],)], "codes array<string>")
    got = df.select(*[labels.positional_label(F.col("codes"), level).alias(level) for level in ("code", "subcode", "combined")]).collect()
    assert [tuple(r) for r in got] == [("x", "y", "x → y"), ("x", None, "x"), (None, None, None)]
    assert labels.strip_columns(frame(spark, [(1, 2)], "` Label A` int, `b-c` int"), {"b_c": "d"}).columns == ["label_a", "d"]
    assert labels.find_column(df, ["z", "codes"]) == "codes" and labels.missing_columns(df, ["z"]) == ["z"]


# hierarchy


def test_sheet_to_tree(spark):
    sheet = frame(spark, [("A b", "x", "S one", "1. First: f\n2. Second: g", 0), (None, None, "S two", None, 1), ("C", "y", None, None, 2)], "`CODE` string, `CODE DEFINITION` string, `SUB-CODE` string, `SUB-CODE DEFINITION` string, row long")
    nodes, edges = hierarchy.parse_sheet(sheet)
    assert {(r["id"], r["type"]) for r in nodes.collect()} == {("A_b", "code"), ("C", "code"), ("S_one", "subcode"), ("S_two", "subcode"), ("First", "subsubcode"), ("Second", "subsubcode")}
    assert {tuple(r) for r in edges.collect()} == {("A_b", "S_one"), ("A_b", "S_two"), ("S_one", "First"), ("S_one", "Second")}
    index = {r["id"]: r["index"] for r in hierarchy.path_index(nodes, edges).collect()}
    assert index["First"] == "1_1_1" and index["S_two"] == "1_2" and index["C"] == "2"


def test_cycles_end(spark):
    nodes = frame(spark, [("a", 0), ("b", 1)], "id string, ord int").withColumn("type", F.lit("code"))
    edges = frame(spark, [("a", "b"), ("b", "a")], "source string, target string")
    assert {r[0] for r in hierarchy.subtree(nodes, edges, "A").collect()} == {"a", "b"}
    assert hierarchy.subtree(nodes, edges, "zzz").count() == 0 and hierarchy.subtree(nodes, edges, "all_node").count() == 2


# neighbours and representations


def test_subtrees_beyond_the_recursion_limit(spark):
    """More rows than SQL recursion may make; a chain, a node reached twice and a cycle end."""
    pairs = [("r", f"n{i}") for i in range(4)] + [(f"n{i % 4}", f"c{i}") for i in range(60)] + [("n0", "c1"), ("x", "y"), ("y", "x")]
    ids = {x for p in pairs for x in p}
    nodes, edges = spark.createDataFrame([(i,) for i in sorted(ids)], "id string"), spark.createDataFrame(pairs, "source string, target string")
    want = {(i, i) for i in ids}
    while more := {(r, t) for r, i in want for s, t in pairs if s == i} - want:
        want |= more
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = [tuple(r) for r in hierarchy.subtrees(nodes, edges).select("root", "id").collect()]
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    assert len(got) == len(want) > 50 and set(got) == want


def test_knn_over_tiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6))
    x[10] = x[11]
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 6)], "id long, vector array<double>")
    got = {(r["i"], r["rank"]): r["j"] for r in neighbours.knn_cosine(df, 3, tile_rows=40).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    for i in range(150):
        want = sorted(range(150), key=lambda j: (-round(near[i, j], 12), j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want


@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=8), min_size=2, max_size=12))
@settings(max_examples=10, deadline=None)
def test_similar_sets_are_complete(spark, sets):
    df = frame(spark, [(i, s) for i, s in enumerate(sets)], "id long, words array<string>")
    got = {(r["i"], r["j"]) for r in neighbours.similar_sets(df, 0.6).collect()}
    uniq = [set(s) for s in sets]
    want = {(i, j) for i, a in enumerate(uniq) for j, b in enumerate(uniq) if i != j and a and b and len(a & b) / len(a | b) >= 0.6}
    assert got == want


def test_sparse_cosine_is_complete(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) for _ in range(6))) for i in range(30)]
    w = represent.tfidf(represent.word_terms(frame(spark, texts, "id long, text string"), 1), 1).cache()
    vec = {}
    for r in w.collect():
        vec.setdefault(r["id"], {})[r["term"]] = r["weight"]
    cos = lambda a, b: sum(v * vec[b].get(t, 0) for t, v in vec[a].items())
    got = {(r["i"], r["j"]) for r in neighbours.sparse_cosine(w, 0.7).collect()}
    assert got == {(a, b) for a in vec for b in vec if a != b and cos(a, b) >= 0.7}
    lsa = {r["id"]: np.array(r["vector"]) for r in represent.lsa(w, 7).collect()}
    assert all(abs(lsa[a] @ lsa[b] - cos(a, b)) < 1e-6 for a in vec for b in vec)  # all directions kept


def test_lsa_of_many_terms_keeps_all(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice([f"w{j}" for j in range(8 * (i % 5), 8 * (i % 5) + 10)]) for _ in range(12))) for i in range(60)]
    w = represent.tfidf(represent.word_terms(frame(spark, texts, "id long, text string"), 1), 1).cache()
    ids = frame(spark, [(i,) for i in range(61)], "id long")
    want = {r["id"]: np.array(r["vector"]) for r in represent.lsa(w, 5).collect()}
    got = {r["id"]: np.array(r["vector"]) for r in represent.lsa(w, 5, 10, ids).collect()}
    assert len(want) == 60 and set(got) == set(range(61)) and got[60].tolist() == [0.0] * 5
    assert all(np.abs(got[i] - want[i]).max() < 1e-5 for i in want)


def test_bigrams(spark):
    rows = represent.word_terms(frame(spark, [(1, "Ab cd x ef"), (2, "zz"), (3, "")], "id long, text string")).collect()
    assert sorted((r["id"], r["term"]) for r in rows) == [(1, "ab"), (1, "ab cd"), (1, "cd"), (1, "cd ef"), (1, "ef"), (2, "zz")]


# phrases


def test_scores_clamp_and_prior(spark):
    rows = frame(spark, [("r1", "a b", "NP", "x"), ("r2", "a b", "NP", "x"), ("r3", "c", "NP", "y"), ("r3", "a b", "NP", "y")], "rec_id string, text string, type string, label string")
    edges = phrases.association(rows)
    pmi = {(r["text"], r["label"]): r["pmi"] for r in edges.collect()}
    assert pmi["a b", "x"] == pytest.approx(math.log2(2 * 3 / (3 * 2))) and pmi["a b", "y"] == pytest.approx(0) and pmi["c", "y"] == pytest.approx(math.log2(3))
    pool = phrases.phrase_pool(rows, edges)
    assert {r["text"]: r["top_label"] for r in pool.collect()} == {"a b": "x", "c": "y"}
    keys, scores = phrases.build_index(pool, edges)
    asked = frame(spark, [("s", "p1", "C", "NP"), ("s", "p2", "unknown", "NP")], "sentence_id string, phrase_id string, text string, type string")
    found = phrases.candidates(asked, keys)
    assert [(r["phrase_id"], r["norm"], r["similarity"]) for r in found.collect()] == [("p1", "c", 1.0)]
    out = {r["label"]: (r["score"], r["probability"]) for r in phrases.sentence_scores(asked, found, scores, phrases.label_prior(edges), {"y": ["c"]}).collect()}
    assert out["x"][0] == pytest.approx(0.5 * math.log(3))
    assert out["y"][0] == pytest.approx(0.5 * math.log(3) + 1.5 * math.log2(3) * math.log(2))
    assert out["x"][1] + out["y"][1] == pytest.approx(1)


def test_fuzzy_candidates(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    keys = frame(spark, [(long, "NP"), (long, "VP"), ("other words", "NP")], "norm string, type string")
    asked = frame(spark, [("s", "p", long + " more", "NP")], "sentence_id string, phrase_id string, text string, type string")
    got = phrases.candidates(asked, keys).collect()
    assert [(r["norm"], r["type"]) for r in got] == [(long, "NP")] and 0.85 <= got[0]["similarity"] < 1


# samples


def test_round_robin(spark):
    rows = [(i, ["big"]) for i in range(10)] + [(20, ["small", "big"]), (21, ["small"])]
    got = sampling.capped_sample(frame(spark, rows, "id long, labels array<string>"), 2).orderBy("round", "id").collect()
    assert [(r["id"], r["label"], r["round"]) for r in got] == [(0, "big", 0), (20, "small", 0), (21, "small", 1)]


def test_splits_are_exact(spark):
    df = spark.range(1000)
    counts = {r["split"]: r["count"] for r in sampling.shuffle_split(df, [("test", 0.15), ("dev", 0.15), ("train", 0.7)]).groupBy("split").count().collect()}
    assert counts == {"test": 150, "dev": 150, "train": 700}
    lone = frame(spark, [(1, "a"), (2, "a"), (3, "b")], "id long, label string")
    assert sampling.stratified_split(lone, "label").where("split = 'test'").count() == 1  # falls back


# graphs


def test_structure_of_small_graphs(spark):
    nodes = frame(spark, [("g", x, "n") for x in "abcd"] + [("h", "z", "n"), ("i", "p", "n"), ("i", "q", "n"), ("i", "r", "n"), ("i", "s", "n")], "graph_id string, id string, label string")
    edges = frame(spark, [("g", "a", "b", "e"), ("g", "b", "c", "e"), ("g", "c", "a", "e"), ("g", "c", "d", "e"), ("g", "d", "c", "e"), ("i", "p", "q", "e"), ("i", "q", "r", "e"), ("i", "r", "p", "e"), ("i", "r", "s", "e")], "graph_id string, source string, target string, label string")
    rows = {r["graph_id"]: r for r in graphs.metrics(nodes, edges).collect()}
    g = rows["g"]
    assert (g["n_nodes"], g["n_edges"], g["diameter"]) == (4, 4, 2)
    assert g["aspl"] == pytest.approx(4 / 3) and g["avg_clustering"] == pytest.approx((1 + 1 + 1 / 3) / 4) and g["density"] == pytest.approx(4 / 6)
    assert g["wl_hash"] == rows["i"]["wl_hash"] != rows["h"]["wl_hash"]
    assert rows["h"]["diameter"] == 0 and rows["h"]["energy"] == 0
    summary = {r["metric"]: r for r in graphs.summary(graphs.metrics(nodes, edges)).collect()}
    assert summary["n_nodes"]["mean"] == 3 and summary["n_nodes"]["distinguishability"] == pytest.approx(2 / 3)


def test_open_role_is_kept(spark):
    tags = frame(spark, [("s", 0, i, f"w{i}", t) for i, t in enumerate(["B-ARG0", "I-ARG0", "B-V", "O", "B-ARG1", "I-ARG1"])], "sentence string, predicate int, pos int, token string, tag string")
    spans_found = graphs.bio_spans(tags)
    assert {(r["role"], r["text"]) for r in spans_found.collect()} == {("ARG0", "w0 w1"), ("V", "w2"), ("ARG1", "w4 w5")}
    assert {(r["source"], r["target"], r["label"]) for r in graphs.role_edges(spans_found).collect()} == {("w2", "w0 w1", "ARG0"), ("w2", "w4 w5", "ARG1")}


# sources and sinks


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"message": "m", "message_id": 1, "annotations": [{"text_id": "1_0", "text": "t", "code": ["x"]}]}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), schemas.MESSAGES).first()["annotations"][0]["code"] == ["x"]
    (tmp_path / "b.json").write_text('{"u1": {"text": "a"}, "u2": {"text": "b"}}')
    assert {tuple(r) for r in readers.sniffed(spark, str(tmp_path / "b.json"), "text:string").collect()} == {("u1", "a"), ("u2", "b")}
    (tmp_path / "c.jsonl").write_text('{"id": "u1", "text": "a"}\nnot json\n{"id": "u2", "text": "b"}\n')
    assert {tuple(r) for r in readers.sniffed(spark, str(tmp_path / "c.jsonl"), "text:string").collect()} == {("u1", "a"), ("u2", "b")}
    assert [r["n"] for r in readers.jsonl(spark, str(tmp_path / "c.jsonl"), "id string, text string", "n").orderBy("n").collect()] == [0, 2]
    (tmp_path / "wide.csv").write_text("w1,w2\ncat,dog\n,bird\n")
    assert sorted(r["words"] for r in readers.topics(spark, str(tmp_path / "wide.csv")).collect()) == [["bird"], ["cat", "dog"]]
    g = tmp_path / "g"
    g.mkdir()
    (g / "one.json").write_text('{"nodes": [{"id": 1, "label": "a"}, {"label": "b"}], "links": [{"source": 1, "target": "node_1", "dep": "x"}]}')
    (g / "bad.json").write_text("{nope")
    nodes, edges, errors = readers.graph_files(spark, str(g))
    assert {tuple(r)[:3] for r in nodes.collect()} == {("one", "1", "a"), ("one", "node_1", "b")}
    assert [(r["source"], r["target"], r["label"]) for r in edges.collect()] == [("1", "node_1", "x")]
    assert [r["graph_id"] for r in errors.collect()] == ["bad"]


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.lit("y"))
    writers.pretty_json(df, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        writers.pretty_json(df, str(tmp_path / "q"), max_rows=3)
    path = str(tmp_path / "resume")
    assert writers.append_missing(df.limit(2), path, "id") == 2
    assert writers.append_missing(df, path, "id") == 3
    assert writers.append_missing(df, path, "id") == 0


def test_json_in_free_text():
    from spanloom.functions.records import balanced_json, load

    assert balanced_json('text {"a": "}", "b": [1, {"c": 2}]} more') == '{"a": "}", "b": [1, {"c": 2}]}'
    assert balanced_json("{bad} then [1, 2]") == "[1, 2]"
    assert balanced_json("{never [closed") is None and balanced_json(None) is None
    assert balanced_json('[open {"a": "\\\\"}') == '{"a": "\\\\"}'
    assert load("spanloom.functions.segment:plain_tagger")("a b")[1].text == "b"
    with pytest.raises(ValueError):
        load("spanloom.functions.segment:MOST_TOKENS")


def test_too_many_regex_rules_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(labels, "BROADCAST_ROWS", 1)
    rules = frame(spark, [("a", "regex", "x"), ("b", "regex", "y")], "target string, kind string, pattern string")
    raws = frame(spark, [("x",), ("y",)], "raw string")
    assert [tuple(r) for r in labels.alias_hits(raws, rules.limit(1)).collect()] == [("a", "x")]
    with pytest.raises(ValueError):
        labels.alias_hits(raws, rules)
