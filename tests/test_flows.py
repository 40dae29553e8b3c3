"""Whole analyses and the parsed-token rules, on small written texts."""

import pytest

from spanloom.functions import fuzzy, segment
from spanloom.functions.segment import ParsedToken
from spanloom.operators import graphs
from spanloom.plans import alignment, flows

CHUNK = "pos long, context string, next string, annotations array<struct<text:string,codes:array<string>,start:bigint,end:bigint>>"


def test_from_chunks_to_report(spark):
    chunks = spark.createDataFrame(
        [
            (0, "Thank you for the call.", "Can I get a refill because mine ran out?", [("Thank you", ["THX", "salut"], None, None)]),
            (1, "Can I get a refill because mine ran out?", None, [("Can I get a refill", ["ask"], None, None)]),
            (2, "Nothing here.", None, None),
        ],
        CHUNK,
    )
    messages = flows.process_messages(chunks).cache()
    assert sorted((r["message"], len(r["annotations"])) for r in messages.collect()) == [("Nothing here.", 0), ("Thank you for the call. Can I get a refill because mine ran out?", 2)]
    mapping = spark.createDataFrame([("THX", "Partnership", "code"), ("salut", "salutation", "subcode"), ("ask", "Request", "code")], "raw string, matched_codebook_label string, level string")
    units = flows.labelled_units(messages, mapping).cache()
    got = {(r["level"], r["text"]): (r["span"], r["code"], r["subcode"]) for r in units.collect()}
    assert got["clause", "Can I get a refill"] == ("Can I get a refill", "Request", None)
    assert got["sentence", "Nothing here."] == (None, None, None)
    report = {r["type"]: r["total"] for r in flows.label_report(units).collect()}
    assert report["code"] >= 1


def test_ambiguity_of_repeated_texts(spark):
    rows = [(i, "a" if i % 2 else "b", None, f"alpha beta gamma delta {'x' if i < 6 else 'y'}{i // 6}") for i in range(12)]
    out = flows.ambiguity(spark.createDataFrame(rows, "id long, label string, span string, text string"), k=3, dims=10)
    assert out["pairs"].count() == 1 and out["summary"].first()["n_items"] == 12
    assert {r["label"] for r in out["labels"].collect()} == {"a", "b"}


def parsed(rows):
    out, at = [], 0
    for i, (text, pos, dep, head, lemma) in enumerate(rows):
        out.append(ParsedToken(text, at, at + len(text), pos, dep, rows[head][1], i, head, lemma))
        at += len(text) + 1
    return out


SENTENCE = parsed([
    ("Sorry", "INTJ", "intj", 2, "sorry"), ("we", "PRON", "nsubj", 2, "we"), ("ran", "VERB", "ROOT", 2, "run"), ("out", "ADP", "prep", 2, "out"), ("of", "ADP", "prep", 3, "of"),
    ("time", "NOUN", "pobj", 4, "time"), ("and", "CCONJ", "cc", 2, "and"), ("he", "PRON", "nsubj", 9, "he"), ("is", "AUX", "cop", 9, "be"), ("busy", "ADJ", "conj", 2, "busy"),
])


def test_clauses_and_phrases_of_a_parsed_sentence():
    ranges = segment.clause_ranges(SENTENCE)
    assert ranges == [(0, 6), (7, 10)]
    assert segment.phrase_ranges(SENTENCE, 0, 6) == [(0, 1, "DISC"), (1, 2, "NP"), (2, 6, "VP_PHV")]
    assert (8, 10, "VP_COP") in segment.phrase_ranges(SENTENCE, 7, 10) or (7, 10, "VP_COP") in segment.phrase_ranges(SENTENCE, 7, 10)
    assert segment.clause_ranges(parsed([("Hello", "INTJ", "ROOT", 0, "hello")])) == [(0, 1)]


def test_dependency_graphs_and_propagation(spark):
    rows = [("g", t.i, t.text, t.pos, t.dep, t.head) for t in SENTENCE]
    nodes, edges = graphs.dependency_graphs(spark.createDataFrame(rows, "graph_id string, i int, text string, pos string, dep string, head int"))
    assert nodes.count() == 10 and edges.count() == 9  # a tree
    x = graphs.one_hot_pos(nodes).cache()
    dim = len(x.first()["features"])
    out = {r["id"]: r["features"] for r in graphs.propagated(x, edges, dim, 1).collect()}
    assert sum(out["1"]) == pytest.approx(1) and sorted(v for v in out["1"] if v) == [0.5, 0.5]


def test_spans_are_located_by_normalised_words(spark, tmp_path):
    long = "the quick brown fox jumps over the lazy dog and runs away"
    spans = [(1, long), (2, "lazy dog, and"), (3, "Dog"), (4, "quick brown"), (5, ""), (6, None), (7, "blue whale sings"), (8, "...")]
    docs = [(1, "He said: \"The quick, brown fox (jumps) over the lazy dog and runs away.\""), (2, f"see{long}s"), (3, "a blue\nwhale sings"), (4, "underdogs"), (5, None), (6, "")]
    spark.createDataFrame(spans, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in alignment._located(spark, str(tmp_path)).collect())
    want = [(d, i, *at) for d, t in docs for i, s in spans if (at := fuzzy.locate(s, t))]
    assert got == want
    assert {(d, i) for d, i, *_ in got} >= {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 7), (4, 3)}
