"""Corpus preparation: each stage calls one operator and is written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clvforge.llm.catalog import model_path
from clvforge.llm.common import table
from clvforge.llm.exact_dedup import kept_documents
from clvforge.llm.mixing import mix, repeat_documents
from clvforge.llm.pieces import encode_documents
from clvforge.llm.quality import good_documents
from clvforge.llm.simhash import first_documents
from clvforge.session import checkpoint_dir, delete_path, release_tables, ship_package, table_mark


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id, stays."""
    ship_package(spark)
    return kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship_package(spark)
    return first_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    ship_package(spark)
    return repeat_documents(docs, mix(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as a digest."""
    ship_package(spark)
    return encode_documents(docs, model_path()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The classifier, the rounding of the mix and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        mark = table_mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        release_tables(spark, mark)  # what the stage wrote on its way, and its predecessor's output
        if n:
            delete_path(spark, f"{folder}/{n - 1}")
    return docs
