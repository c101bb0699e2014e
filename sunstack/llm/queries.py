"""One query for each operator of this subpackage, over its whole table and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, minhash, packing, ppm, quality, sharding, substring, suffix
from .oracles import ORACLES
from .tables import load


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_pages(load(spark, sf_dir, "pages")).withColumnRenamed("doc_id", "page_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), **quality.PRODUCTION)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    chats = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.format_chats(chats, tokenizer("byte_bpe_50k.json"))


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(load(spark, sf_dir, "documents"))


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"), [1.0] * 24)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(load(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_quality_rules, op3_chat_formatting, op4_ppm_scoring, op5_wu_manber_decontamination,
              op6_rendezvous_sharding, op7_best_fit_packing, op8_minhash_near_dedup, op9_suffix_array_dedup, op10_substring_dedup)
}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
