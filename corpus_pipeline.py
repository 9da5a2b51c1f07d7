"""Corpus preparation from raw documents to shards.

Each stage calls one operator and returns a DataFrame, which is written as Parquet and read again for the next one. All
stages but the last return documents with their own columns; the last one adds the shard and the slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import decontam, jaccard, mixing, quality, sharding
from lexspark.llm.common import importable, remove, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    importable(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each component stays. Shingles have five words, links a similarity of 0.8."""
    importable(spark)
    return jaccard.deduplicated(docs, options=jaccard.JoinOptions(shingle=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark passage go, however long they are."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the documents with their shard and slot; columns of the result's names give way."""
    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    return sharding.shard(docs, carry=tuple(c for c in docs.columns if c.lower() not in own))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: SQL cannot express the first stage, which is learned.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with a table in the shared checkpoint folder between any two.

    A table goes when the next one is written; the last one, from which the result is computed, when the driver's JVM ends.
    """
    docs = table(spark, sf_dir, "documents")
    folder, spent = scratch(spark, "pipeline"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if spent:
                remove(spark, spent)
            spent = f"{folder}/{k}"
    return docs
