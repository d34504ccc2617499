"""Chunk search: filters, the latest version of each group, similarity, collapsing by group, top k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

CHUNK = (
    "offset long, id long, vector array<float>, content string, metadata struct<filename:string, processed_at:bigint, category:string, "
    "language:string, status:string, version:string, group_id:bigint, document_id:string>"
)
#: Metadata fields that hits may be grouped by.
GROUPS = ("filename", "category", "language", "status", "version", "group_id", "document_id")


def filtered(chunks: DataFrame, category: str | None = None, status: str | None = None, language: str | Sequence[str] | None = None) -> DataFrame:
    """Chunks whose metadata equal what is given; a missing value equals nothing.  ``language`` is one or a list."""
    out = chunks
    for name, value in (("category", category), ("status", status)):
        if value is not None:
            out = out.where(F.col(f"metadata.{name}") == value)
    if isinstance(language, str):
        out = out.where(F.col("metadata.language") == language)
    elif language is not None:
        out = out.where(F.col("metadata.language").isin(list(language)))
    return out


def latest_versions(chunks: DataFrame) -> DataFrame:
    """Of each group_id the chunk with the largest processed_at (missing: 0), of equal ones the first written; chunks without
    a group_id all stay."""
    grouped, free = (chunks.where(f"metadata.group_id IS {x} NULL") for x in ("NOT", ""))
    newest = F.struct(F.coalesce("metadata.processed_at", F.lit(0)).alias("at"), (-F.col("offset")).alias("first"))
    best = grouped.groupBy(F.col("metadata.group_id").alias("g")).agg(F.max_by(F.struct(*chunks.columns), newest).alias("row"))
    return best.select("row.*").unionByName(free)


def group_key(field: str | None) -> Column:
    """The group of a chunk: the field's value; without one, or by an unknown field, a chunk is a group of its own."""
    own = F.concat(F.lit("chunk:"), F.col("offset").cast("string"))
    if field not in GROUPS:
        return own
    return F.coalesce(F.concat(F.lit("value:"), F.col(f"metadata.{field}").cast("string")), own)


def collapsed(scored: DataFrame, limit: int = 1, top_k: int | None = None) -> DataFrame:
    """The ``limit`` best rows of each ``key``; groups by their best score, rows by score in them, then the first ``top_k`` rows.

    Ties: groups by key, rows by offset.
    """
    within = Window.partitionBy("key")
    ranked = scored.withColumn("rank", F.row_number().over(within.orderBy(F.desc("score"), "offset"))).where(F.col("rank") <= limit)
    led = ranked.withColumn("leader", F.max("score").over(within))
    ordered = led.orderBy(F.desc("leader"), "key", F.desc("score"), "offset")
    return ordered.limit(top_k) if top_k is not None else ordered


def search(
    chunks: DataFrame,
    query: Column,
    top_k: int = 10,
    category: str | None = None,
    status: str | None = None,
    language: str | Sequence[str] | None = None,
    group_by: str | None = None,
    group_limit: int = 1,
) -> DataFrame:
    """(id, content, metadata, score), best first.

    Ranking reads metadata and vectors alone; contents are joined to the top_k rows at the end.  Chunks whose vector has
    another length than the query's are passed over.
    """
    narrow = latest_versions(filtered(chunks.select("offset", "id", "vector", "metadata"), category, status, language))
    scored = narrow.where(F.size("vector") == F.size(query)).select("offset", "id", "metadata", V.cosine(F.col("vector"), query).alias("score"))
    if group_by is None:
        hits = scored.withColumn("key", F.lit("")).withColumn("leader", F.col("score")).orderBy(F.desc("score"), "offset").limit(top_k)
    else:
        hits = collapsed(scored.withColumn("key", group_key(group_by)), group_limit, top_k)
    # at most top_k rows
    full = F.broadcast(hits.select("offset", "key", "leader", "score")).join(chunks.select("offset", "id", "content", "metadata"), "offset")
    return full.orderBy(F.desc("leader"), "key", F.desc("score"), "offset").select("id", "content", "metadata", "score")
