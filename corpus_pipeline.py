"""From raw documents to a sharded training set; each stage works on all that the one before kept.

Every stage takes empty tables, which stay empty, and reads very long texts whole; ties are told apart by hashes of the rows or
by the least id, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barsmith.llm import decontamination, jaccard_join, language_id, mixing, sharding
from barsmith.llm.common import small_batches, stored, table

#: Least confidence in a document's language.
LEAST_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, a clear language and words that this language knows; the others go, null and empty texts
    with them. Null labels aren't learned from; repeated rows are all judged alike; columns of any name stay as they are."""
    small_batches(spark)
    return language_id.in_known_language(docs, language_id.fit(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of its least id; rows without words or without an id all stay. Columns
    of any name stay as they are."""
    small_batches(spark)
    return jaccard_join.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, those with null or empty texts among them; windows of items
    without an id count too. Columns of any name stay as they are."""
    small_batches(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null sources are one source, and documents without words are taken
    as often as the chance of their source says. Columns of any name stay as they are."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it (columns of these two names are replaced); null texts have no bytes."""
    return sharding.shard_records(docs)


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources", mix),
    ("sharding", shards),
]
#: A trained language model decides in the first stage, and a hash-seeded draw in the fourth: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
