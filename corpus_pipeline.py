"""The training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, decontamination, language, secrets, simhash
from tesserae.llm._common import new_folder, table
from tesserae.llm.registry import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language."""
    found = language.identify(language.document_evidence(docs), language.train(docs))
    return found.where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; n_chars follows the text."""
    columns = docs.columns
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return bpe.encode_with_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret scan", remove_secrets),
    ("byte-level BPE", encode_bytes),
]

#: SimHash components, trained language models and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(folder := new_folder(spark, f"pipeline-{k}"))
            docs = spark.read.parquet(folder)
    return docs
