"""The thin queries over the driver's tables, one for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from . import conversations, decontaminate, language_id, licenses, matroska, minhash, quality, secrets, sentencepiece_fst, spelling, suffix_dedup, url_filter
from .sharding import hilbert_shards


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_column(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damaged(turns), turns)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_report(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_secrets": op2_secrets, "op3_sentencepiece": op3_sentencepiece, "op4_quality": op4_quality, "op5_matroska": op5_matroska, "op6_decontaminate": op6_decontaminate, "op7_minhash": op7_minhash, "op8_sharding": op8_sharding, "op9_language": op9_language, "op10_url_filter": op10_url_filter, "op11_conversations": op11_conversations, "op12_spelling": op12_spelling, "op13_licenses": op13_licenses}


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": url_filter.ORACLE_SQL, "op11_conversations": conversations.ORACLE_SQL, "op12_spelling": spelling.ORACLE_SQL, "op13_licenses": licenses.ORACLE_SQL}
