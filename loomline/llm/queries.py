"""The queries of the training-data operators, by name: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, digest, html_text, mixing, quality, rules, sharding, simhash, warc
from .common import read


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.digests(turns, public_tokenizers.path("byte_bpe_50k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_html": op1_html,
    "op2_digest": op2_digest,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_rules": op8_rules,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op3_sharding": sharding.ORACLE_SQL,
    "op8_rules": rules.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
