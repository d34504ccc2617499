"""Reciprocal rank fusion of several hit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fused(lists: list[DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """(id, rrf_score, payload) of lists with id, rank (from 1) and payload: the sum of 1 / (rrf_k + rank) over the lists.

    An id that is in several lists keeps the payload of the first of them.  Best first, ties by id.  Ids are compared as
    strings; rows without one are passed over.
    """
    every = None
    for n, hits in enumerate(lists):
        one = hits.select(F.col("id").cast("string").alias("id"), F.col("rank").cast("long").alias("rank"), F.col("payload"), F.lit(n).alias("list")).where("id IS NOT NULL")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("rrf_score"), F.min_by("payload", F.struct("list", "rank")).alias("payload"))
    return best.orderBy(F.desc("rrf_score"), "id")


def ranked(hits: DataFrame, *order) -> DataFrame:
    """``hits`` (already cut to a bounded top list) with rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (id, payload) with rank from 1 in the order that they come in, that of the statement's ORDER BY.

    Rows are numbered within their partitions, and partitions hold ranges of that order; what partitions before hold is added,
    so no task sees all rows.  The numbers are fixed by one pass: rows are cached, not computed twice.
    """
    at = rows.withColumn("__at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("__at", 33)
    starts, n = {}, 0
    for p, m in sorted((r.part, r.n) for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each partition
        starts[p] = n
        n += m
    if not starts:
        return at.select("id", F.lit(1).cast("long").alias("rank"), "payload")
    begin = F.create_map(*(F.lit(x) for p in starts for x in (p, starts[p])))[part]
    return at.select("id", (begin + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("long").alias("rank"), "payload")
