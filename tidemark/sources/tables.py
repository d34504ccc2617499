"""Parquet tables and chunk logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that setting takes a temporary one, a cluster is
    refused, since its machines don't see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as a collection: id, vector, label."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Offsets, ids and metadata alone: the scan reads neither vectors nor contents."""
    return chunks.select("offset", "id", "metadata")


def prefix_scan(state: DataFrame, prefix: str | None, limit: int, now_ms: int, cap: int = 1000) -> DataFrame:
    """Live rows whose key begins with ``prefix``, in the order of keys, ``limit`` (at most ``cap``) of them."""
    rows = state.where(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))
    if prefix:
        rows = rows.where(F.col("key").startswith(prefix))
    return rows.orderBy("key").limit(min(limit, cap))
