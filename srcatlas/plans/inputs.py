"""Inputs shared by the registered queries: fixture files -> documents -> chunks.

Each is a lazy DataFrame over the parquet tables of ``sf_dir``; nothing is
materialised until a query's result is consumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, files as fo
from ..sources import fixtures as fx


def files(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, "fx_files")


def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, "fx_stored_files")


def documents(spark: SparkSession, sf: str, policy: str = "ingest") -> DataFrame:
    return fo.load_documents(files(spark, sf), policy)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_fixed(documents(spark, sf))


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """fx_code as a file inventory: the path is the document number (no suffix)."""
    c = fx.view(spark, sf, "fx_code")
    return c.select(
        "doc_id", "repo", F.concat(F.lit("/data/"), F.col("repo")).alias("repo_source"),
        F.col("doc_id").cast("string").alias("rel_path"),
        F.length("content").cast("bigint").alias("size_bytes"), "content")


def code_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fo.build_documents(code_files(spark, sf))


def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_fixed(code_documents(spark, sf))
