"""Text representations and the models on them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import char_ngrams, model_words
from spanloom.operators.labels import small
from spanloom.session import written

#: Terms up to which the Gram matrix is solved on the driver; beyond that, directions are iterated on the rows.
MAX_DENSE_TERMS = 1500
#: Directions iterated beside those asked for, rounds at most, and the change of singular values that ends them.
EXTRA, ROUNDS, SETTLED = 20, 60, 1e-9
#: Numbers of a block of term vectors in one row.
BLOCK_TERMS = 2000


def word_terms(texts: DataFrame, most: int = 2) -> DataFrame:
    """id, term of all word n-grams up to ``most``, repeats kept; words of one character are dropped."""
    words = texts.select("id", model_words(F.col("text")).alias("w"))
    grams = [F.col("w")]
    for n in range(2, most + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        grams.append(_joined(starts, n))
    return words.select("id", F.explode(F.concat(*grams)).alias("term"))


def _joined(starts, n: int):
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))


def char_terms(texts: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """id, term of distinct character n-grams of the padded lower-case text."""
    grams = F.flatten(F.array(*[char_ngrams(F.lower("text"), n) for n in range(low, high + 1)]))
    return texts.select("id", F.explode(grams).alias("term"))


def tfidf(terms: DataFrame, min_df: int = 2, max_df: float = 1.0, documents: int | None = None) -> DataFrame:
    """id, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit vectors.

    ``documents``: their number, if some may have no term at all.
    """
    tf = terms.groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = documents if documents is not None else tf.select("id").distinct().count()
    keep = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    raw = tf.join(keep, "term").withColumn("weight", F.col("tf") * (F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0))
    size = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    return raw.join(size, "id").select("id", "term", (F.col("weight") / F.col("size")).alias("weight"))


def lsa(weights: DataFrame, k: int = 200, dense: int = MAX_DENSE_TERMS, ids: DataFrame | None = None) -> DataFrame:
    """id, vector: documents in the space of the k strongest directions of all terms, as unit vectors.

    Up to ``dense`` terms, the directions come from the Gram matrix of the terms,
    summed where the rows lie. Beyond that, the Gram matrix is multiplied with a
    block of k and some more vectors in rounds, until the values settle or ``ROUNDS`` are over; rows meet
    the terms' vectors in joins, and only matrices of the block's side reach the
    driver. Each direction's sign makes its largest part positive. ``ids``: texts
    that get a row in any case; those without terms have a vector of zeros.
    """
    spark = weights.sparkSession
    weights = written(weights.select("id", "term", "weight"), "lsa-weights")
    terms = weights.select("term").distinct()
    m = terms.count()
    if m > dense:
        out, width = _lsa_iterated(weights, k, m)
    elif m:
        out, width = _lsa_dense(weights, k)
    else:
        out, width = spark.createDataFrame([], "id long, vector array<double>"), 0
    if ids is None:
        return out
    zeros = F.array_repeat(F.lit(0.0), width)
    return ids.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("vector", zeros).alias("vector"))


def _lsa_dense(weights: DataFrame, k: int) -> tuple[DataFrame, int]:
    spark = weights.sparkSession
    heavy = [r["term"] for r in weights.groupBy("term").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).orderBy(F.desc("s"), "term").collect()]
    m = len(heavy)
    place = spark.createDataFrame([(t, i) for i, t in enumerate(heavy)], "term string, p int")
    rows = weights.join(F.broadcast(place), "term").select("id", "p", "weight")
    docs = rows.groupBy("id").agg(F.collect_list("p").alias("p"), F.collect_list("weight").alias("w"))

    def gram(batches):
        total = np.zeros((m, m))
        for b in batches:
            for p, w in zip(b["p"], b["w"]):
                total[np.ix_(p, p)] += np.outer(w, w)
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    sums = docs.select("p", "w").mapInPandas(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (sums[c].to_numpy() for c in ("i", "j", "v"))  # as columns, of half the square of ``dense`` terms at most
    whole = np.zeros((m, m))
    whole[i, j] = whole[j, i] = v
    values, vectors = np.linalg.eigh(whole)
    basis = vectors[:, np.argsort(-values, kind="stable")[: min(k, m)]]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    sent = spark.sparkContext.broadcast(basis)

    def project(batches):
        for b in batches:
            out = [np.asarray(w) @ sent.value[np.asarray(p)] for p, w in zip(b["p"], b["w"])]
            yield pd.DataFrame({"id": b["id"], "vector": [v / (np.linalg.norm(v) or 1.0) for v in out]})

    return docs.mapInPandas(project, "id long, vector array<double>"), basis.shape[1]


def _summed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """key, x: sums of weight * x; partly where the rows lie, so that no term is gathered in one task."""

    def part(batches):
        sums: dict = {}
        for b in batches:
            codes, keys = pd.factorize(b[key])
            x = np.stack(b["x"].to_list()) * b["weight"].to_numpy()[:, None] if len(b) else np.zeros((0, width))
            total = np.zeros((len(keys), width))
            np.add.at(total, codes, x)
            for name, row in zip(keys, total):
                if name in sums:
                    sums[name] += row
                else:
                    sums[name] = row
            if len(sums) >= BLOCK_TERMS:
                yield pd.DataFrame({key: list(sums), "x": list(sums.values())})
                sums = {}
        yield pd.DataFrame({key: list(sums), "x": list(sums.values())})

    kind = dict(rows.dtypes)[key]
    parts = rows.select(key, "weight", "x").mapInPandas(part, f"{key} {kind}, x array<double>")
    return parts.groupBy(key).agg(*[F.sum(F.get("x", i)).alias(f"x{i}") for i in range(width)]).select(key, F.array(*[f"x{i}" for i in range(width)]).alias("x"))


def _inner(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of outer products of x with itself."""

    def part(batches):
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_list())
                total += x.T @ x
        yield pd.DataFrame({"v": [total.ravel()]})

    return sum((np.asarray(r["v"]) for r in rows.select("x").mapInPandas(part, "v array<double>").toLocalIterator()), np.zeros(width * width)).reshape(width, width)


def _turned(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        for b in batches:
            x = np.stack(b["x"].to_list()) @ sent.value if len(b) else []
            yield pd.DataFrame({key: b[key], "x": list(x)})

    return rows.select(key, "x").mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, x array<double>")


def _whitener(inner: np.ndarray) -> np.ndarray:
    """Turns x with these inner products into orthonormal directions, the strongest first; those that vanish are dropped."""
    values, vectors = np.linalg.eigh(inner)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    kept = values > max(values[0], 0) * 1e-13
    return vectors[:, kept] / np.sqrt(values[kept])


def _lsa_iterated(weights: DataFrame, k: int, m: int) -> tuple[DataFrame, int]:
    """Subspace iteration on the terms' Gram matrix."""
    spark, width = weights.sparkSession, min(k + EXTRA, m)

    def start(batches):
        for b in batches:
            yield pd.DataFrame({"term": b["term"], "x": [np.random.default_rng(zlib.crc32(t.encode())).normal(size=width) for t in b["term"]]})

    block = written(weights.select("term").distinct().mapInPandas(start, "term string, x array<double>"), "lsa-block")
    block = written(_turned(block, "term", _whitener(_inner(block, width))), "lsa-block")
    before = None
    for _ in range(ROUNDS):
        width = block.select(F.size("x")).first()[0]
        docs = written(_summed(weights.join(block, "term"), "id", width), "lsa-docs")
        values, vectors = np.linalg.eigh(_inner(docs, width))  # of the Gram matrix within the block
        order = np.argsort(-values, kind="stable")[: min(k, width)]
        if before is not None and len(before) == len(order) and np.abs(values[order] - before).max() <= SETTLED * values[order[0]]:
            break
        before = values[order]
        ahead = written(_summed(weights.join(docs, "id"), "term", width), "lsa-ahead")
        block = written(_turned(ahead, "term", _whitener(_inner(ahead, width))), "lsa-block")
    else:
        width = block.select(F.size("x")).first()[0]
        docs = written(_summed(weights.join(block, "term"), "id", width), "lsa-docs")
        values, vectors = np.linalg.eigh(_inner(docs, width))
        order = np.argsort(-values, kind="stable")[: min(k, width)]
    basis = vectors[:, order]
    largest = _turned(block, "term", basis).agg(*[F.max(F.struct(F.abs(F.get("x", i)), F.col("term"), F.get("x", i).alias("v"))).alias(f"m{i}") for i in range(len(order))]).first()
    basis = basis * np.array([-1.0 if largest[i]["v"] < 0 else 1.0 for i in range(len(order))])
    turned = _turned(docs, "id", basis)
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return turned.select("id", F.when(size > 0, F.transform("x", lambda v: v / size)).otherwise(F.col("x")).alias("vector")), len(order)


def vectors_or_tfidf(texts: DataFrame, embeddings: DataFrame | None, k: int = 200) -> DataFrame:
    """Given vectors (id, vector), or, where there are none, LSA of TF-IDF."""
    if embeddings is not None:
        return texts.select("id").join(embeddings.select("id", "vector"), "id")
    return lsa(tfidf(word_terms(texts)), k, ids=texts)


def kmeans(items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, cluster of each (id, vector)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = items.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def prototypes(items: DataFrame, dim: int) -> DataFrame:
    """label, prototype: the mean vector of each label, as a unit vector."""
    means = items.groupBy("label").agg(*[F.avg(F.get("vector", i).cast("double")).alias(f"m{i}") for i in range(dim)])
    size = F.sqrt(sum((F.col(f"m{i}") * F.col(f"m{i}") for i in range(1, dim)), F.col("m0") * F.col("m0")))
    return means.withColumn("size", size).select("label", F.array(*[F.when(F.col("size") > 0, F.col(f"m{i}") / F.col("size")).otherwise(0.0) for i in range(dim)]).alias("prototype"))


def prototype_cosines(items: DataFrame, found: DataFrame) -> DataFrame:
    """id, label, cosine of each item with each prototype; labels are a codebook's."""
    from spanloom.functions.numbers import dot, norm

    rows = items.select("id", "vector").crossJoin(small(found))
    size = norm(F.col("vector"))
    return rows.select("id", "label", F.when(size > 0, dot(F.col("vector"), F.col("prototype")) / size).otherwise(0.0).alias("cosine"))


def weighted_logistic(items: DataFrame, seed: int = 0, max_iter: int = 50):
    """A multinomial logistic model of (vector, label) whose rows weigh inversely to their label's share; returns (model, label names)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r["label"]: r["n"] for r in items.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts, key=str)
    total = sum(counts.values())
    table = items.sparkSession.createDataFrame([(x, float(i), total / (len(names) * counts[x])) for i, x in enumerate(names)], f"label {dict(items.dtypes)['label']}, index double, class_weight double")
    rows = items.join(F.broadcast(table), "label").select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"), F.col("index").alias("label"), "class_weight")
    return LogisticRegression(weightCol="class_weight", maxIter=max_iter, family="multinomial", regParam=1e-4).fit(rows), names


def predict(model, names: list, items: DataFrame) -> DataFrame:
    """id, true_label, pred_label, probabilities (by label)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = model.transform(items.select("id", F.col("label").alias("true_label"), array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    labels = F.array(*[F.lit(str(x)) for x in names])
    p = vector_to_array("probability")
    return rows.select("id", F.col("true_label").cast("string").alias("true_label"), F.get(labels, F.col("prediction").cast("int")).alias("pred_label"), F.map_from_arrays(labels, p).alias("probabilities"))


def mlp(items: DataFrame, hidden: list[int], seed: int = 42, max_iter: int = 60):
    """A multilayer perceptron of (vector, label); returns (model, label names)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    names = sorted((r[0] for r in items.select("label").distinct().collect()), key=str)
    dim = items.select(F.max(F.size("vector"))).first()[0]
    table = items.sparkSession.createDataFrame([(x, float(i)) for i, x in enumerate(names)], f"label {dict(items.dtypes)['label']}, index double")
    rows = items.join(F.broadcast(table), "label").select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"), F.col("index").alias("label"))
    return MultilayerPerceptronClassifier(layers=[dim, *hidden, len(names)], seed=seed, maxIter=max_iter).fit(rows), names
