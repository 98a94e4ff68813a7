"""A training corpus from ``documents``: five stages, each on all that the one before kept.

The quality classifier drops what it rejects, near-dedup keeps one document of each group, decontamination drops
documents that share a region with a benchmark item, the secret scan masks live-looking credentials and keeps all
documents, and byte-level BPE encodes what is left, decodes it again and gives the token ids with digests of both.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import bpe_duckdb, decontaminate, neardup, quality, queries, secrets
from emberline.session import settled, ship

#: Bytes of encoded words that a Python worker of the last stage remembers; its executors still hold what earlier stages left in their heaps.
BPE_MEMORY = 64 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(quality.document_statistics(docs), labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe_duckdb.round_trip(docs, queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern(), keep_ids=True, memory=BPE_MEMORY)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on the way, and what it read, goes once its result is stored."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES:
        docs, path = settled(spark, functools.partial(stage, spark, docs, sf_dir), f"stage-{name}", read)
        read = (path,)
    return docs
