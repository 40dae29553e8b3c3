"""Best-fit packing of token sequences with large-item matching.

Lengths are whole numbers of at most the capacity, so packing is planned on
their histogram: a few thousand counts, however many documents. The plan is a
list of runs ("the next n pieces of this length go, k to a bin, into bins from b
on at this offset"); pieces find their place by their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage

CAPACITY, END_ID = 4096, 1
#: Rows that a rank bucket holds on average at most.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 64
#: Words that a worker remembers, and bytes of text it encodes at once.
CACHE_WORDS, CHUNK_BYTES = 600_000, 1 << 20
#: Runs of letters (of ASCII or beyond), and of what is neither a letter nor a blank.
PIECE = re.compile(rb"[A-Za-z\x80-\xff]+|[^A-Za-z\x80-\xff\x20\x09-\x0D]+").findall
DIGIT = re.compile(rb"[0-9]").search
SUFFIX = re.compile(rb"'[A-Za-z]").search
ASCII = bytes(range(128))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _plain(text: bytes) -> bool:
    """Whether a text falls into the pieces of ``PIECE`` under the vocabulary's own rules.

    Those part runs of letters from everything else, but for an apostrophe with
    some letters; and signs beyond ASCII may join signs of it.
    """
    if b"<|" in text or b"'" in text and SUFFIX(text):  # what may be a special token, or an apostrophe with letters
        return False
    return all(c.isalpha() and c.lower().isalpha() for c in set(text.translate(None, ASCII).decode()))


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Texts to little-endian ids; runs of letters repeat, so a worker encodes each once and then looks it up.

    The vocabulary's rules drop white space, never look across it, lower-case, and
    treat runs of letters and what lies between them each by itself, in all but
    few texts; those are encoded whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known: dict[bytes, bytes] = {}

    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for w, i in tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def code(texts: list[str]) -> list[bytes]:
        coded = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [np.array(ids, "<u4").tobytes() for ids in coded]

    def learn(pieces: list[bytes]) -> None:
        """Pieces without digits are a word each, with one id that ends it, and are encoded together."""
        one = [p for p in pieces if not DIGIT(p)]
        for i in range(0, len(one), 4000):
            own = one[i : i + 4000]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = np.nonzero(ends[ids])[0] + 1
            if len(at) != len(own):
                known.update(zip(own, code([w.decode() for w in own])))
                continue
            flat, stops = ids.tobytes(), (4 * at).tolist()
            known.update(zip(own, map(flat.__getitem__, map(slice, [0, *stops[:-1]], stops))))
        rest = [p for p in pieces if DIGIT(p)]
        known.update(zip(rest, code([w.decode() for w in rest])))

    def encode(texts: list[bytes]) -> list[bytes]:
        if len(known) > CACHE_WORDS:
            known.clear()
        split = [PIECE(t.lower()) if _plain(t) else None for t in texts]
        learn(list(set(chain.from_iterable(p for p in split if p)).difference(known)))
        whole = iter(code([t.decode() for t, p in zip(texts, split) if p is None]))
        get = known.__getitem__
        return [next(whole) if p is None else b"".join(map(get, p)) for p in split]

    return encode


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document's ids with ``end_id`` added; only longer ones are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = _encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size + sizes[hi] <= CHUNK_BYTES):
                    size, hi = size + sizes[hi], hi + 1
                out = []
                for doc, coded in zip(ids[lo:hi], encode(texts.slice(lo, hi - lo).to_pylist())):
                    coded += end
                    for p, at in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[at : at + 4 * capacity]
                        out.append((doc, p, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), ARROW.types)], schema=ARROW)
                lo = hi

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, bins): runs are (length, first rank, first bin, pieces per bin, offset).

    Lengths above a third of the capacity go first: the longest left is paired
    with the longest that fits beside it, two to a bin at most. Shorter ones,
    longest first, go each to the bin with the smallest gap that takes it, as
    long as one does, then to a new bin. Equal lengths move in runs.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def put(length: int, items: int, at: int, per_bin: int, offset: int) -> None:
        runs.append((length, rank[length], at, per_bin, offset))
        rank[length] += items
        left[length] -= items

    def free(gap: int, at: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((at, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a)
        b = large[k - 1] if k else 0
        if b == a and left[a] < 2:
            b = large[k - 2] if k > 1 else 0
        if not b:
            n = left[a]
            put(a, n, bins, 1, 0)
            free(capacity - a, bins, n)
        else:
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b:
                put(a, 2 * n, bins, 2, 0)
            else:
                put(a, n, bins, 1, 0)
                put(b, n, bins, 1, a)
            free(capacity - a - b, bins, n)
        bins += n
        large = [x for x in large if left[x]] if not left[a] or (b and not left[b]) else large
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            k = bisect.bisect_left(order, s)
            if k == len(order):
                n = -(-left[s] // (capacity // s))
                free(capacity, bins, n)
                bins += n
                continue
            gap = order[k]
            at, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            fill = min(gap // s, left[s])
            full = min(n, left[s] // fill)
            put(s, full * fill, at, fill, capacity - gap)
            free(gap - fill * s, at, full)
            free(gap, at + full, n - full)
    return runs, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless sequences of at most ``capacity`` ids."""
    pieces = stage(pieces, "pack-pieces")
    counts = {r["length"]: r["c"] for r in pieces.groupBy("length").agg(F.count("*").alias("c")).collect()}  # one row for each length
    runs, _ = plan_bins(counts, capacity)
    runs.sort()
    buckets = max(LEAST_BUCKETS, -(-sum(counts.values()) // BUCKET_ROWS))
    length, first, at, per, offset = (np.array(x, dtype=np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 5
    starts = (length << 44) + first

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(starts, (n << 44) + rank, "right") - 1
        step = rank - first[k]
        return pd.DataFrame({"sequence_id": at[k] + step // per[k], "offset": offset[k] + step % per[k] * n})

    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    ahead = F.sum("c").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = stage(sums.select("length", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead")), "pack-ranks")
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    rows = rows.withColumn("rn", own).join(sums.hint("merge"), ["length", "bucket"])  # dealt alike already
    rows = rows.withColumn("p", place("length", F.col("ahead") + F.col("rn") - 1))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the end id alone. Documents longer than the capacity
    are cut into full pieces and a last one. Rows that repeat an id are packed
    each for itself. An empty table gives no rows; other columns are ignored.
    ``tokenizer_path`` must be readable on every executor.
    """
    return pack(cut_documents(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
