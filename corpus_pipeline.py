"""A corpus pipeline: identified languages, no near copies, no benchmark leaks, mixed sources, shards.

Every stage keeps all columns of its input, extra ones too, whatever their names;
the last one gives each row's place instead. Defined results: null and empty texts go in
the first stage, as they have no language; very long texts are read whole by every
stage. Of texts that are alike the smallest doc_id stays; rows without a doc_id stay.
Repeated rows of one doc_id are one document to the near-copy search, and both stay or
both go. A null source is a source of its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.llm import decontam, langid, mixing, neardup, sharding
from geoweave.scratch import forget, materialize, scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language the byte convolutional network cannot identify."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8)."""
    return neardup.keep_one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents are taken as often as its tempered weight asks for."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in the shards along the Hilbert curve."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("minhash_neardup", near_copies),
    ("decontamination", benchmark_leaks),
    ("temperature_mixing", mixture),
    ("hilbert_sharding", shards),
]

#: A trained network and LSH are among the stages, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; the tables that stages make on their way are removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, outside=True)
        if before is not None:
            forget(before)
        before = docs
    return docs
