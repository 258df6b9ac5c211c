"""From raw documents to token ids: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents, and others that the
table may have, whatever their names.

Edge cases: null and empty texts are not toxic but fail the quality rules, so
they end there. Null ids, languages and sources stay as they are. Rows that
repeat id and text are copies, of which near-dedup keeps one; rows that share
an id only are told apart by text. The mix repeats documents of sources whose
target exceeds their size. Empty tables pass through as empty ones.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from grovework.llm import curriculum, queries, simhash, toxicity, weakrules
from grovework.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out; those that the
    classifier calls toxic go."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return toxicity.only_clean(docs, toxicity.learn(docs, labels, ~queries.fifth()))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are probably bad go."""
    return weakrules.only_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles,
    similarity 0.8 or more) stays: the one with the smallest id."""
    return simhash.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order: those that the mix doesn't take go,
    those that it takes again repeat."""
    return curriculum.training_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaner than the query alone, because workers keep what earlier stages took."""
    return queries.encoded(docs, cache_words=100_000, batch_bytes=2_000_000, release=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenize),
]

#: A classifier and expectation-maximisation are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
