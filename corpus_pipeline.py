"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peerlens.llm import decontamination, language_id, mixing, ngram_join, sharding
from peerlens.llm.common import write_scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays unclear, go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest id."""
    return ngram_join.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage occurs go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken 0 to 3 times, so that the sources' words come to their targets."""
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes, with a place in each."""
    return sharding.shard_documents(docs, 16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
#: The stages learn models, sample and cut trees, which plain SQL does not express.
ORACLE_SQL: str | None = None
#: Bytes of a batch that a Python worker is sent at once: two workers of an executor hold a few of these each, beside the heap.
BATCH_BYTES = 4 << 20


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; what each returns is written and read again."""
    docs, limit = spark.read.parquet(f"{sf_dir}/documents.parquet"), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, str(BATCH_BYTES))
    try:
        for name, stage in STAGES[:-1]:
            docs = write_scratch(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
    return STAGES[-1][1](spark, docs, sf_dir)
