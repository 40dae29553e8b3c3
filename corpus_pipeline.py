"""Corpus pipeline: quality, exact copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import jaccard_join, mixing, packing, quality, radix_dedup
from spanloom.llm.common import scratch
from spanloom.llm.queries import tokenizer_path
from spanloom.session import ship

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.7
#: Weights of the sources in code-point order, and how often a document may be repeated.
SOURCE_WEIGHTS, MAX_EPOCHS = [5, 2, 1], 3
CAPACITY = 4096


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    ship(spark)
    return radix_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words to a shingle, similarity 0.8 or more."""
    ship(spark)
    return jaccard_join.drop_near_copies(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    ship(spark)
    return mixing.mixed_rows(docs, mixing.cycle_weights(SOURCE_WEIGHTS), max_epochs=MAX_EPOCHS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequences and places."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training and tokenising can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's tables are deleted once its rows are written, those once the next has read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as keep_last:
        for name, function in STAGES[:-1]:
            with scratch() as keep:
                docs = keep(function(spark, docs, sf_dir), name.replace(" ", "-"))
        name, function = STAGES[-1]
        return keep_last(function(spark, docs, sf_dir), name)
