"""The corpus queries registered by name; SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import bpe, chat, collocations, decontam, ngramlm, permindex, piececount, resample, sharding, simhash, substrings, toxicity, urlrules
from pageloom.llm.oracles import ORACLES
from pageloom.session import table

__all__ = ["ORACLES", "QUERIES"]

MULTI_50K = "byte_bpe_multi_50k.tiktoken"
PIECE_32K = "piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.nearest(table(spark, sf_dir, "embeddings"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlrules.RULES, "verdict string, rule string")
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_50K), public_tokenizers.PATTERN))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piececount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_32K))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_permutation_index": op2_permutation_index,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontaminate": op4_decontaminate,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_rules": op6_url_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_token_counts": op12_token_counts,
    "op13_importance_resample": op13_importance_resample,
    "pipeline": corpus_pipeline.run,
}
