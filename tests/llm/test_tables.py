"""Mixing, packing, sharding, WARC and exact dedup against brute force."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import mixing, packing, queries, radix_dedup, sharding, warc

from .helpers import edge_docs, empty_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# mixing


@given(st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from([1, 2, 5, 100])), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_water_fill_is_feasible_and_proportional(parts):
    sizes, weights = zip(*parts)
    targets = mixing.water_fill(sizes, weights, sum(sizes), 3)
    assert all(t <= 3 * s for t, s in zip(targets, sizes))
    assert sum(targets) == pytest.approx(sum(sizes))
    rates = [t / w for t, w, s in zip(targets, weights, sizes) if t < 3 * s]
    assert not rates or max(rates) == pytest.approx(min(rates))


def check_mix(rows, texts):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"]
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest + 1e-6
    assert Counter(r["size"] for r in rows) == Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)


def test_mix_takes_its_targets(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = mixing.mix(docs, mixing.cycle_weights([5, 2, 1])).collect()
    check_mix(rows, [r["text"] for r in docs.collect()])
    again = mixing.mix(docs.repartition(7), mixing.cycle_weights([5, 2, 1])).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_edges(spark):
    docs = edge_docs(spark)
    rows = mixing.mix(docs, mixing.cycle_weights([5, 2, 1])).collect()
    assert len(rows) == docs.count()
    assert {r["source"] for r in rows} == {"a", "b", "c", "é", None}
    assert mixing.mix(empty_docs(spark), mixing.cycle_weights([1])).count() == 0
    copies = mixing.mixed_rows(docs, mixing.cycle_weights([5, 2, 1]))
    assert copies.columns == docs.columns
    assert copies.count() == sum(r["repeats"] for r in rows)


def test_capped_sources_take_no_fourth_copy(spark):
    rows = [(i, "" if i % 2 else "one two three", "small") for i in range(40)] + [(100 + i, "w " * 500, "large") for i in range(40)] + [(200 + i, None, "none") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in mixing.mix(docs, lambda sources: [1000 if s == "small" else 1 for s in sources]).collect()}
    assert {r["repeats"] for i, r in found.items() if i < 40} == {3} and max(r["repeats"] for r in found.values()) == 3
    copies = Counter(r["doc_id"] for r in mixing.mixed_rows(docs, lambda sources: [1000 if s == "small" else 1 for s in sources]).collect())
    assert copies == Counter({i: r["repeats"] for i, r in found.items() if r["repeats"]})


# packing


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[doc, p, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [4096, 256])
def test_packing_against_the_tokenizer(spark, sf_dir, capacity):
    docs = docs_of(spark, sf_dir)
    rows = packing.pack_documents(docs, TOKENIZER, capacity).collect()
    bins = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], capacity)
    assert bins <= 1.03 * sum(r["length"] for r in rows) / capacity + 1


def test_packing_edges(spark):
    docs = edge_docs(spark)
    check_packing(packing.pack_documents(docs, TOKENIZER).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 4096)
    assert packing.pack_documents(empty_docs(spark), TOKENIZER).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
@settings(max_examples=120, deadline=None)
def test_plan_places_every_piece_once(counts):
    runs, bins = packing.plan_bins(counts, 60)
    runs.sort()
    used, spots = Counter(), set()
    for i, (n, first, at, per, offset) in enumerate(runs):
        last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else counts[n]
        for r in range(first, last):
            used[n] += 1
            for x in range(n):
                spot = (at + (r - first) // per, offset + (r - first) % per * n + x)
                assert spot not in spots and spot[1] < 60
                spots.add(spot)
    assert used == Counter(counts)
    fill = Counter(b for b, _ in spots)
    assert all(max(x for b2, x in spots if b2 == b) + 1 == fill[b] for b in fill)
    assert len(fill) <= bins


# sharding


def check_shards(rows, docs, shards):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    mean, largest = sum(r["size"] for r in rows) / shards, max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in by[k]) - mean) <= 0.03 * mean + largest for k in range(shards))


def test_shards_are_near_equal(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    check_shards(sharding.shard(docs, 40).collect(), docs.collect(), 40)


def test_hot_text_is_split_by_id(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}", "en", "a", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sharding.shard(docs, 10).collect()
    check_shards(found, docs.collect(), 10)
    assert Counter(map(tuple, found)) == Counter(map(tuple, sharding.shard(docs.repartition(5), 10).collect()))


def test_rows_that_repeat_id_and_text_are_dealt_to_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rows = [(7 if i % 3 else i, "same" if i % 3 else f"text {i}") for i in range(3000)] + [(None, "same")] * 200 + [(None, "x" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_shards(sharding.shard(docs, 5).collect(), docs.collect(), 5)


def test_shard_edges(spark):
    docs = edge_docs(spark)
    check_shards(sharding.shard(docs, 3).collect(), docs.collect(), 3)
    assert sharding.shard(empty_docs(spark), 3).count() == 0


# WARC


def arc_file(version, records):
    """Records of (line without its length, block) as a file of that version."""
    block = f"{version} 0 x\n{warc.ARC_FIELDS[version]}\n".encode()
    blank = b"" if version == "1" else b" 200 - - 0 x"
    out = b"filedesc://x 0.0.0.0 20200101000000 text/plain%s %d\n%s\n" % (blank, len(block), block)
    return out + b"".join(b"%s %d\n%s\n" % (line, len(body), body) for line, body in records)


def test_arc_versions_and_lengths():
    data = arc_file("1", [(b"http://a 1.2.3.4 20200102030405 text/html", b"ab\n\ncd\r\n\n")]) + arc_file("2", [(b"http://b 1.2.3.4 20200102030405 text/html 200 - - 0 b", b"")])
    found = list(warc.parse_arc(data))
    assert [(u, c) for _, u, _, _, _, i, c in found if not i] == [("http://a", b"ab\n\ncd\r\n\n"), ("http://b", b"")]
    assert all(data[at:].startswith((b"filedesc", b"http")) for at, *_ in found)
    odd = arc_file("1", [(b"http://a b/\xe9\xc3\xa9 1.2.3.4 1999 text/html", b"x")])
    assert [u for _, u, *_, i, _ in warc.parse_arc(odd) if not i] == ["http://a%20b/%E9é"]
    assert [warc.stamp(d) for d in ("19990102030405", "199901", "1999", "x", "")] == ["1999-01-02T03:04:05Z", "1999-01-01T00:00:00Z", "1999-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a no length\n"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://a 0 2020 text/plain 2\n9 \n"))


@pytest.mark.parametrize("version", ["1", "2"])
def test_foreign_archives_go_byte_for_byte(spark, tmp_path, version):
    """Latin-1, image, gzip and random payloads without the key header, copies among them."""
    rng = random.Random(3)
    blank = b"" if version == "1" else b" 200 - - 0 x"
    latin, image, zipped = "<p>caf\xe9</p>".encode("latin-1") * 200, bytes(range(256)) * 20, gzip.compress(bytes(rng.randbytes(5000)), mtime=0)
    bodies = [latin, image, zipped, image, b"", b"\r\n\r\n", b"WARC/1.1\r\n", *(rng.randbytes(rng.randrange(3000)) for _ in range(30)), zipped]
    head = b"HTTP/1.1 200 OK\r\nX-Name: caf\xe9\r\nContent-Type: text/html"
    records = [(b"http://h/%d 1.2.3.4 20200102030405 text/html%s" % (i, blank), head + b"\r\n\r\n" + b) for i, b in enumerate(bodies)]
    records.append((b"dns:example.org 1.2.3.4 20200102030405 text/dns%s" % blank, latin))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.arc").write_bytes(arc_file(version, records))
    (tmp_path / "in" / "y.arc.gz").write_bytes(gzip.compress(arc_file(version, records[:3])))
    warc.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), archive_bytes=4000)
    rows = warc.read_warc(spark, str(tmp_path / "out"), payloads=True).collect()
    assert len(rows) == len(records) + 3 and len({r["id"] for r in rows}) == len(rows)
    by_id = {r["id"]: r for r in rows}
    for r in rows:
        want = latin if r["uri"] == "dns:example.org" else bodies[int(r["uri"].rsplit("/", 1)[1])]
        assert (r["bytes"], r["digest"], r["date"]) == (len(want), hashlib.sha1(want).hexdigest(), "2020-01-02T03:04:05Z")
        if r["type"] == "revisit":
            assert r["payload"] is None and bytes(by_id[r["refers_to_id"]]["payload"]) == want and len(want) >= 1000
        else:
            assert bytes(r["payload"]) == want
    kinds = Counter((r["type"], r["digest"]) for r in rows)
    assert kinds["resource", hashlib.sha1(latin).hexdigest()] == 1
    for big, n in ((latin, 2), (image, 3), (zipped, 3)):
        assert kinds["response", hashlib.sha1(big).hexdigest()] == 1 and kinds["revisit", hashlib.sha1(big).hexdigest()] == n - 1
    heads = warc.read_arc(spark, str(tmp_path / "in")).where("octet_length(head) > 0").select("head").distinct().collect()
    assert [bytes(r["head"]) for r in heads] == [head]


def test_archives_stay_small(spark, tmp_path):
    """A run of large pages makes many files, not one."""
    rows = [(2**60 + i, f"http://{i}", "x" * (200_000 if i < 20 else 10)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_arc(pages, str(tmp_path / "a"), archive_bytes=500_000)
    assert len(list((tmp_path / "a").glob("part-*"))) >= 7
    warc.convert(spark, str(tmp_path / "a"), str(tmp_path / "w"), archive_bytes=500_000)
    found = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r["key"] for r in found) == [2**60 + i for i in range(300)]
    assert {r["refers_to"] for r in found if r["type"] == "revisit"} == {2**60 + 19}


def test_pages_make_the_trip(spark):
    big = "<p>ü\r\n\r\nWARC/1.1\r\n</p>" * 80
    rows = [(1, "http://a b", big), (2, None, big), (9, "http://c", big), (3, "http://d", ""), (4, "", None), (5, "http://e", "small"), (6, "http://f", "small"), (None, "http://g", "none"), (7, "x", "r"), (7, "x", "r"), (8, "y", big + "8"), (8, "y", big + "8")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS value")
    found = warc.convert_pages(pages).collect()
    got = Counter((r["key"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in found)
    sha = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    want = Counter((i, *sha(t), "revisit" if i in (1, 2) else "response", 9 if i in (1, 2) else None) for i, _, t in rows[:-1])
    assert got == want + Counter([(8, *sha(big + "8"), "revisit", 8)])  # of rows that repeat an id and a payload, one is the response
    assert {r["uri"] for r in found if r["key"] == 1} == {"http://a%20b"}
    assert warc.convert_pages(pages.limit(0)).count() == 0


# exact dedup


def test_exact_groups_edges(spark):
    docs = edge_docs(spark)
    rows = radix_dedup.exact_groups(docs, first=4, factor=2).collect()
    texts = Counter((r["text"] or "") for r in docs.collect())
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["group_size"] == texts[sha[r["text_sha256"]]]
    for h, t in sha.items():
        own = [r for r in rows if r["text_sha256"] == h]
        assert sum(r["kept"] for r in own) == 1
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert {r["keep_id"] for r in own} == {max(ids) if ids else None}
    assert radix_dedup.exact_groups(empty_docs(spark)).count() == 0
    kept = radix_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)


def test_texts_that_differ_late_stay_apart(spark):
    base = "a" * 5000
    rows = [(i, base + "b" * (i % 3) + "c" * (2 - i % 3)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in radix_dedup.exact_groups(docs).collect()}
    assert found == {i: (6 + i % 3, 3) for i in range(9)}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_counts(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0
