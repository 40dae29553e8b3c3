"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Words and their shapes (runs of character classes) get sparse random index
vectors; a word's vector is the normalised sum of the index vectors around it in
the training texts. A document pools its words' and its shapes' vectors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Bounds of the sample that the model is fitted on: labelled rows, and bytes of their texts.
MAX_ROWS, MAX_BYTES = 4000, 16 << 20
#: Numbers of a vector, non-zeros of an index vector, words each way that count as context.
DIM, NONZERO, WINDOW = 48, 6, 2
#: In how many training texts a word or a shape must occur to have a vector of its own; there are as many as the bounded sample holds.
MIN_TEXTS = 3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 4e-3, 1e-4
#: Words that a worker remembers, and texts that leave Arrow's memory at once.
CACHE_WORDS, PART = 100_000, 64
#: Letters up to which a word is one token, and letters of the pieces that longer ones are cut into.
LONG, PIECE = 64, 12

_SIGNS = {code: sign for first, last, sign in (("A", "Z", "A"), ("À", "Ö", "A"), ("Ø", "Þ", "A"), ("a", "z", "a"), ("ß", "ö", "a"), ("ø", "ÿ", "a"), ("0", "9", "0")) for code in range(ord(first), ord(last) + 1)}
_REPEATS = re.compile(r"(.)\1+").sub


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each, other signs once for each run."""
    return _REPEATS(r"\1", word.translate(_SIGNS))


def _tokens(text: str | None) -> list[str]:
    """Words between ASCII blanks, long ones in pieces; a word that repeats the one before and a line seen before are marked."""
    out: list[str] = []
    lines: set[str] = set()
    for line in (text or "").split("\n"):
        words = line.split()
        if words and line in lines:
            out.append("\nline")
        lines.add(line)
        if len(line) > LONG and max(map(len, words), default=0) > LONG:
            words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE if len(w) > LONG else len(w))]
        out += words
    return out


@dataclass
class Model:
    words: dict[str, int]
    shapes: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def score(self, texts: Iterable[str | None], cache: dict | None = None) -> np.ndarray:
        """Probability of label 1 for each text; every text gets one, empty ones that of no words."""
        texts = list(texts)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (pool(texts, self.words, self.shapes, self.vectors, cache) - self.mean) / self.scale
        return np.round(_sigmoid(_forward(x, self.layers)[1] / self.temperature), 6)  # beyond that, sums depend on the batch


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _codes(texts: list, words: dict, shapes: dict, cache: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """(code of each token, tokens of each text); a code holds the rows of a token's word and shape."""
    cache = {} if cache is None else cache
    if len(cache) > CACHE_WORDS:
        cache.clear()
    parts, sizes, other = [], [], shapes["\nother"]
    for text in texts:
        tokens = _tokens(text)
        for t in set(tokens).difference(cache):
            s = shapes.get(shape_of(t), other)
            cache[t] = words.get(t, s) << 32 | s
        parts.append(np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens)))
        sizes.append(len(tokens))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(sizes, np.int64)


def pool(texts: list, words: dict, shapes: dict, vectors: np.ndarray, cache: dict | None = None) -> np.ndarray:
    """Means of the texts' word and shape vectors, the share of repeated neighbours, and their length."""
    out = np.zeros((len(texts), 2 * vectors.shape[1] + 3))
    for i in range(0, len(texts), 64):  # so that a batch of long texts needs little memory
        codes, sizes = _codes(texts[i : i + 64], words, shapes, cache)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for j, n in enumerate(sizes):
            own = codes[at[j] : at[j] + n]
            if n:
                kinds, back, counts = np.unique(own, return_inverse=True, return_counts=True)
                share = counts / n
                out[i + j, : vectors.shape[1]] = share @ vectors[kinds >> 32]
                out[i + j, vectors.shape[1] : -3] = share @ vectors[kinds & 0xFFFFFFFF]
                out[i + j, -3:-1] = (own[1:] == own[:-1]).mean() if n > 1 else 0.0, len(kinds) / n
            out[i + j, -1] = np.log1p(n)
    return out


def _index_vectors(names: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of each name's vector, drawn from its own hash."""
    places, signs = np.zeros((len(names), NONZERO), np.int64), np.zeros((len(names), NONZERO))
    for i, name in enumerate(names):
        rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
        places[i], signs[i] = rng.permutation(DIM)[:NONZERO], rng.choice([-1.0, 1.0], NONZERO)
    return places, signs


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.maximum(x @ a + b, 0)
    return hidden, hidden @ c + d


def _train(x: np.ndarray, y: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            own = order[i : i + BATCH]
            hidden, z = _forward(x[own], layers)
            g = (_sigmoid(z) - y[own]) / len(own)
            back = np.outer(g, layers[2]) * (hidden > 0)
            grads = [x[own].T @ back, back.sum(0), hidden.T @ g, g.sum()]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + (DECAY * layers[k] if k in (0, 2) else 0)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def train(texts: list[str | None], labels: list[int], seed: int = 5) -> Model:
    """A model of the labelled texts; one in five is held back to set the temperature.

    Without two kinds of label there is nothing to tell apart: every text then
    scores their mean (0.5 without any).
    """
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return Model({}, {}, np.zeros((0, 0)), np.zeros(0), np.ones(0), [], 1.0, float(y.mean()) if len(y) else 0.5)
    spread: Counter[str] = Counter()
    forms: Counter[str] = Counter()
    for t in texts:
        own = set(_tokens(t))
        spread.update(own)
        forms.update({shape_of(w) for w in own})
    shapes = {s: i for i, s in enumerate(sorted(s for s, c in forms.items() if c >= MIN_TEXTS or "\n" in s))}
    shapes.setdefault("\nother", len(shapes))
    known = sorted((w for w, c in spread.items() if c >= MIN_TEXTS), key=lambda w: (-spread[w], w))
    words = {w: len(shapes) + i for i, w in enumerate(known)}
    places, signs = _index_vectors([*shapes, *words], seed)
    context = np.zeros((len(places), DIM))
    flat = context.reshape(-1)
    cache: dict = {}
    for i in range(0, len(texts), 64):
        codes, sizes = _codes(texts[i : i + 64], words, shapes, cache)
        own, form, text = codes >> 32, codes & 0xFFFFFFFF, np.repeat(np.arange(len(sizes)), sizes)
        for o in range(1, WINDOW + 1):
            near = text[o:] == text[:-o]
            for rows in (own, form):
                a, b = rows[:-o][near], rows[o:][near]
                for at, by in ((a, b), (b, a)):
                    np.add.at(flat, (at[:, None] * DIM + places[by]).ravel(), signs[by].ravel())
    index = np.zeros_like(context)
    np.put_along_axis(index, places, signs, 1)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = (index / np.sqrt(NONZERO) + context / np.where(norm > 0, norm, 1)).astype(np.float32)

    x = pool(texts, words, shapes, vectors, cache)
    held = np.random.default_rng(seed).permutation(len(x)) % 5 == 0
    if len(set(y[~held])) < 2 or not held.any():
        held[:] = False
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    x = (x - mean) / scale
    layers = _train(x[~held], y[~held], seed)
    temperature = 1.0
    if held.any():
        z = _forward(x[held], layers)[1]
        ones, zeros = y[held].sum(), (1 - y[held]).sum()
        aim = np.where(y[held] > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # so that a clean split doesn't ask for certainty
        loss = lambda t: -np.mean(aim * np.log(_sigmoid(z / t) + 1e-12) + (1 - aim) * np.log(1 - _sigmoid(z / t) + 1e-12))
        temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return Model(words, shapes, vectors, mean, scale, layers, temperature)


def fold(id_col: Column) -> Column:
    """crc32 of an id's text, modulo 4; 2 is held out."""
    return F.crc32(id_col.cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, seed: int = 5) -> Model:
    """Fit on a seeded sample of the labelled rows that aren't held out, of at most ``max_rows`` rows and ``max_bytes`` of text.

    Rows without an id or a label teach nothing. The sample is drawn by id, so
    reruns fit the same model: ids in the order of their draw, without those whose
    texts don't fit into what is left of the bounds. Only the sample, and before
    it ids and sizes of some ``max_rows`` drawn, reach the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 2))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    n = known.count()
    some = known.where(unit < max_rows / max(1, n))
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(some), "id")  # some max_rows ids
    some = stage(some, "quality-sample")
    drawn = some.groupBy("id", unit.alias("u")).agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.count("*").alias("n")).collect()
    ids, bytes_left, rows_left = [], max_bytes, max_rows
    for r in sorted(drawn, key=lambda r: (r["u"], r["id"])):
        if r["b"] <= bytes_left and r["n"] <= rows_left:
            ids.append(r["id"])
            bytes_left, rows_left = bytes_left - r["b"], rows_left - r["n"]
    rows = sorted(some.where(F.col("id").isin(ids)).collect(), key=lambda r: (r["id"], r["t"] or "", r["y"]))
    return train([r["t"] for r in rows], [r["y"] for r in rows], seed)


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score of each row's whole text by ``model``, sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [sent.value.score(texts.slice(i, PART).to_pylist(), cache) for i in range(0, len(texts), PART)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(docs[text_col])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Scores depend on the text alone. Null texts score as empty ones; a null id is
    not held out. Without labels, or with labels of one kind, all score their
    mean (0.5 without any). An empty table gives no rows; other columns are
    ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), scores(docs, model, text_col).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = fit(docs, labels, **options)
    score = scores(docs, model, options.get("text_col", "text"))
    return docs.withColumn("__score", score).where(F.col("__score") >= threshold).drop("__score")
