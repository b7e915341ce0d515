"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licences, media, mixing, packing, quality, scoring, sharding, simhash, urls
from .common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(read(spark, sf_dir, "documents"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the text; conversation -1 probes the escapes."""
    return chat.format_conversations(chat.with_probe(read(spark, sf_dir, "conversations"))).drop("layout", "formatted", "loss_spans")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"), words=3)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(read(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.mix_sql(),
        "op2_url_filters": urls.rules_sql(),
        "op4_licence_scan": licences.licences_sql(),
        "op6_chat_format": chat.chat_sql(),
        "op8_quality_rules": quality.repetition_sql(),
    }
