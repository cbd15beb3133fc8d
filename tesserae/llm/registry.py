"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, hamming, language, licenses, lm, secrets, sharding, simhash
from ._common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    records = chat.record_rows(table(spark, sf_dir, "conversations"))
    probes = chat.one_record(spark, {"conv_id": -1, "messages": [{"role": "user", "content": probe}, {"role": "assistant", "content": probe}]})
    return chat.conversation_digests(chat.canonical_turns(records.unionByName(probes)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.corpus_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_components(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.embedding_neighbors(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.document_scores(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_slots(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_with_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_formatting, op2_language_id, op3_simhash, op4_top_k, op5_secret_scan, op6_lm_scoring, op7_license_scan, op8_decontamination, op9_sharding, op10_byte_bpe)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL for the queries that it can express."""
    from .oracles import ORACLES

    return dict(ORACLES)
