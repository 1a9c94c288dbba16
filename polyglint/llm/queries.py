"""Registered queries of the corpus operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_reuse,
    langid,
    licenses,
    metric_join,
    mixing,
    sanitize,
    sharding,
    simhash,
    sketch,
    suffix_dedup,
    token_store,
    turn_repair,
    whitening,
)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# all but equal weights: more than the natural shares of the given tables reach
MIX_ENTROPY_SHARE = 0.9999


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, entropy_share=MIX_ENTROPY_SHARE).drop("text")


ORACLE["op1_mix_sources"] = mixing.oracle(entropy_share=MIX_ENTROPY_SHARE)


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.find(read(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint(read(spark, sf_dir, "documents"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read(spark, sf_dir, "documents"))


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(read(spark, sf_dir, "documents"))


@query
def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.digests(read(spark, sf_dir, "documents"))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_and_audit(read(spark, sf_dir, "conversations"))


ORACLE["op11_turn_repair"] = turn_repair.oracle()


@query
def op12_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


ORACLE["op12_byte_shards"] = sharding.oracle()


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"))
