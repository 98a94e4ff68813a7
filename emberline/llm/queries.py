"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import bpe_duckdb, chat, decontaminate, media, neardup, phrases, quality, repair, secrets, sharding, suffix_dedup, token_counts, token_files

#: Where the public vocabulary files are.
TOKENIZERS = None


def tokenizer(name: str) -> str:
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_shards(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality.document_statistics(_table(spark, sf_dir, "documents"))
    return quality.score(table, quality.fit(table, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.length_histogram(token_counts.encoded_lengths(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), pattern()))


def op4_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.with_other_answers(_table(spark, sf_dir, "conversations")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_duckdb.round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sniff_media(media.write_media(_table(spark, sf_dir, "documents")))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damaged(turns), turns.select(turns.conv_id.cast("long").alias("conv_id")).distinct())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_quality, op3_token_counts, op4_chat_preferences, op5_token_files, op6_secrets, op7_near_duplicates, op8_decontamination, op9_bpe_duckdb, op10_media, op11_suffix_dedup, op12_repair, op13_collocations)}

ORACLE_SQL = {"op1_sharding": sharding.shards_sql(), "op4_chat_preferences": chat.PAIRS_SQL, "op11_suffix_dedup": suffix_dedup.REMOVAL_SQL, "op13_collocations": phrases.COLLOCATIONS_SQL}
