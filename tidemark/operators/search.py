"""Similarity search: exact top-k, batches of queries, quantised shortlists, segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ship


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def scores(items: DataFrame, query: Column, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """``items`` with ``score``.  Under "dot" both sides are brought to unit length; vectors of another length are skipped."""
    same = items.where(F.size(vector) == F.size(query))
    if metric == "dot":
        return same.withColumn("score", V.dot(V.l2_normalize(F.col(vector)), V.l2_normalize(query)))
    return same.withColumn("score", V.cosine(F.col(vector), query))


def top(scored: DataFrame, k: int, id_column: str = "id") -> DataFrame:
    """The k best, by score downwards, then by id."""
    return scored.orderBy(F.desc("score"), F.asc(id_column)).limit(k)


def exact(items: DataFrame, query: Column, k: int, metric: str = "cosine", vector: str = "vector", id_column: str = "id") -> DataFrame:
    return top(scores(items, query, metric, vector), k, id_column)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that have length ``dim``, as rows, and their places in the column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fit = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == dim)
    if len(fit) < len(column):
        column = column.take(pa.array(fit))
    flat = column.flatten().to_numpy(zero_copy_only=False) if len(fit) else np.zeros(0)
    return flat.reshape(len(fit), dim).astype(np.float64), fit


class Best:
    """The k best (score, id) of each query over batches; of equal scores the smaller id stays."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """``scores`` of the queries ``rows`` (one row of the matrix each) and the items ``ids`` (a column each)."""
        if not scores.size:
            return
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        least = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] > self.k else np.full(len(scores), -np.inf)
        i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        row, score, id_ = np.concatenate((self.row, rows[i])), np.concatenate((self.score, scores[i, j])), np.concatenate((self.id, ids[j]))
        order = np.lexsort((id_, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.score, self.id = row[keep], score[order][keep], id_[order][keep]

    def batch(self, numbers: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(numbers[self.row], pa.int64()), pa.array(self.id, pa.int64()), pa.array(self.score, pa.float64())], names=["query_id", "id", "score"])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def best_of(parts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best of what tasks have kept."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def batch(items: DataFrame, queries: pd.DataFrame, k: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the k best items for each row of ``queries`` (query_id, vector).

    The queries are a stated set and go out in blocks of at most ``block``.  Each Arrow batch of items is one matrix product
    with a block; a task keeps k items per query, and the final k come from those.
    """
    spark = items.sparkSession
    ship(spark)
    out = None
    for at in range(0, len(queries), block):
        part = queries.iloc[at : at + block]
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(np.int64), _unit(np.array(part["vector"].tolist(), dtype=np.float64))))

        def run(batches):
            numbers, q = shared.value  # noqa: B023
            best, every = Best(len(q), k), np.arange(len(q))
            for b in batches:
                x, fit = matrix(b.column("vector"), q.shape[1])
                best.add(every, q @ _unit(x).T, b.column("id").to_numpy(zero_copy_only=False)[fit])
            yield best.batch(numbers)

        one = items.select("id", "vector").mapInArrow(run, "query_id long, id long, score double")
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], "query_id long, id long, score double, rank int") if out is None else best_of(out, k)


def refined(items: DataFrame, query: Column, k: int, shortlist: int, vector: str = "vector", id_column: str = "id") -> DataFrame:
    """Top k by cosine among the ``shortlist`` items with the best quantised dot product."""
    codes = V.q8_quantize(F.col(vector))
    rough = items.withColumn("rough", V.q8_dot(codes, V.q8_quantize(query))).orderBy(F.desc("rough"), F.asc(id_column)).limit(shortlist)
    return exact(rough, query, k, "cosine", vector, id_column)


def merged(parts: Sequence[DataFrame], k: int, id_column: str = "id") -> DataFrame:
    """The k best of several hit lists; an id that is in several counts once, with its best score."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top(every.groupBy(id_column).agg(F.max("score").alias("score")), k, id_column)


def by_segment(items: DataFrame, query: Column, k: int, segments: int, vector: str = "vector", id_column: str = "id") -> DataFrame:
    """Each segment's k best (a segment is a hash of the id), then the k best of those."""
    segment = F.pmod(F.xxhash64(id_column), F.lit(segments))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("score"), F.asc(id_column)))
    local = scores(items, query, vector=vector).select(id_column, "score", segment.alias("segment")).withColumn("__rank", rank).where(F.col("__rank") <= k)
    return merged([local.select(id_column, "score")], k, id_column)
