"""Cluster index: spherical k-means centroids, items laid out by cluster, probing and refinement.

The index is a layout, not a structure in memory: items are written partitioned by cluster, so that a probe reads the
files of ``nprobe`` clusters alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexSettings
from ..functions import vectors as V
from ..session import ship
from . import search

# fixed values
SEED = 0xDEADBEEF
ITERATIONS = 15

#: A stored index: an item's codes beside its vector, in folders by cluster.
LAYOUT = "id string, vector array<float>, meta string, nearer array<int>, codes struct<scale:double,data:array<tinyint>>, cluster int"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def kmeans(x: np.ndarray, clusters: int, seed: int = SEED, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centroids.  Seeds are drawn with a chance of (1 - best similarity) squared; an empty cluster keeps its centroid."""
    draw = np.random.default_rng(seed)
    x = _unit(np.asarray(x, dtype=np.float64))
    chosen = [int(draw.integers(len(x)))]
    best = x @ x[chosen[0]]
    while len(chosen) < clusters:
        weight = np.maximum(0, 1 - best) ** 2
        if weight.sum() <= 1e-12:
            break
        chosen.append(int(draw.choice(len(x), p=weight / weight.sum())))
        best = np.maximum(best, x @ x[chosen[-1]])
    centroids = x[chosen].copy()
    for _ in range(iterations):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centroids)) > 0
        centroids[filled] = _unit(sums[filled])
    return centroids


def train(items: DataFrame, settings: IndexSettings) -> DataFrame | None:
    """(cluster, centroid) from a sample of at most ``training_sample`` items (those with the smallest hash of id, so the
    same at every run); None if there are fewer items than ``min_train`` or clusters."""
    s = settings.clamped()
    sample = items.orderBy(F.xxhash64("id"), "id").limit(s.training_sample).select("vector").toPandas()["vector"].tolist()
    if len(sample) < max(s.min_train, s.clusters):
        return None
    found = kmeans(np.array(sample), s.clusters)
    return items.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(found)], "cluster int, centroid array<double>")


def needs_training(upserts_since: int, live: int, trained: bool, settings: IndexSettings) -> bool:
    s = settings.clamped()
    return live >= s.min_train and (not trained or upserts_since >= s.retrain_min)


def assign(items: DataFrame, centroids: DataFrame, copies: int = 1) -> DataFrame:
    """``items`` with ``cluster``, that of the most similar centroid (ties: the smallest number).

    With ``copies`` above 1 an item has a row for each of so many most similar centroids, and ``nearer``, the clusters of its
    copies before this one: who reads one of those passes this copy over.  The centroids are a bounded set (the setting's
    number of clusters); they go out once and meet items in matrix products.
    """
    ship(items.sparkSession)
    rows = centroids.orderBy("cluster").collect()
    shared = items.sparkSession.sparkContext.broadcast((np.array([r.cluster for r in rows], dtype=np.int32), _unit(np.array([r.centroid for r in rows], dtype=np.float64))))
    copies = min(copies, len(rows))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        numbers, c = shared.value
        x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
        return pd.Series(list(numbers[np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :copies]]))

    known = items.withColumn("__near", nearest("vector"))
    if copies == 1:
        return known.withColumn("cluster", F.col("__near")[0]).drop("__near")
    out = known.select("*", F.posexplode("__near").alias("__at", "cluster"))
    return out.withColumn("nearer", F.slice("__near", F.lit(1), F.col("__at"))).drop("__near", "__at")


def coded(items: DataFrame) -> DataFrame:
    """``items`` with their codes, so that a shortlist needs no arithmetic on the vectors."""
    return items.withColumn("codes", V.q8_quantize(F.col("vector")))


def write(assigned: DataFrame, path: str) -> None:
    assigned.repartition("cluster").sortWithinPartitions("id").write.mode("overwrite").partitionBy("cluster").parquet(path)


def probes(centroids: DataFrame, query: Column, nprobe: int) -> list[int]:
    """The clusters nearest to a query; the centroids are few, so the answer becomes a filter on the partitions."""
    near = centroids.withColumn("score", V.cosine(F.col("centroid"), query)).orderBy(F.desc("score"), "cluster").limit(nprobe)
    return [r.cluster for r in near.select("cluster").collect()]


def near(assigned: DataFrame, centroids: DataFrame, query: Column, settings: IndexSettings) -> DataFrame:
    """The items of the ``nprobe`` clusters next to a query, each once: of a written layout, the files of those folders alone."""
    chosen = probes(centroids, query, settings.clamped().nprobe)
    found = assigned.where(F.col("cluster").isin(chosen))
    return found.where(~F.arrays_overlap(F.coalesce("nearer", F.array().cast("array<int>")), F.array(*map(F.lit, chosen)))) if "nearer" in assigned.columns and chosen else found


def shortlisted(items: DataFrame, query: Column, size: int) -> DataFrame:
    """The ``size`` items whose codes have the largest dot product with the query's."""
    rough = V.q8_dot(F.col("codes"), V.q8_quantize(query))
    return items.withColumn("rough", rough).orderBy(F.desc("rough"), "id").limit(size).drop("rough")


def probe(assigned: DataFrame, centroids: DataFrame, query: Column, k: int, settings: IndexSettings) -> DataFrame:
    """Probe, shortlist by quantised dot product (of stored codes, where there are), refine exactly, top k."""
    s = settings.clamped()
    items = near(assigned, centroids, query, s)
    if "codes" not in items.columns:
        items = coded(items)
    return search.exact(shortlisted(items, query, max(s.refine, k)), query, k)


def batch_probe(assigned: DataFrame, centroids: DataFrame, queries: pd.DataFrame, k: int, nprobe: int, block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank) for many queries: each meets the items of its ``nprobe`` clusters.

    The queries are a stated set and go out in blocks; the items of a cluster and of an Arrow batch are one matrix product with
    the queries that probe the cluster, a task keeps k items per query, and nothing but those is shuffled.
    """
    spark = assigned.sparkSession
    ship(spark)
    rows = centroids.orderBy("cluster").collect()
    c, numbers = _unit(np.array([r.centroid for r in rows], dtype=np.float64)), np.array([r.cluster for r in rows])
    copies = "nearer" in assigned.columns
    out = None
    for at in range(0, len(queries), block):
        part = queries.iloc[at : at + block]
        q = _unit(np.array(part["vector"].tolist(), dtype=np.float64))
        probed = np.zeros((len(q), int(numbers.max()) + 1), dtype=bool)
        near = numbers[np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :nprobe]]
        probed[np.arange(len(q))[:, None], near] = True
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(np.int64), q, probed))

        def run(batches):
            ids_q, q, probed = shared.value  # noqa: B023
            best = search.Best(len(q), k)
            for b in batches:
                x, fit = search.matrix(b.column("vector"), q.shape[1])
                x, cluster, ids = _unit(x), b.column("cluster").to_numpy(zero_copy_only=False)[fit], b.column("id").to_numpy(zero_copy_only=False)[fit]
                before = [np.array(v or [], dtype=np.int64) for v in b.column("nearer").take(pa.array(fit)).to_pylist()] if copies else None
                for n in np.unique(cluster):
                    asked, own = np.flatnonzero(probed[:, n]), np.flatnonzero(cluster == n)
                    if len(asked):
                        # a copy counts if none of the clusters before it is probed
                        allowed = ~np.stack([probed[asked][:, before[i]].any(axis=1) for i in own], axis=1) if copies else None
                        best.add(asked, q[asked] @ x[own].T, ids[own], allowed)
            yield best.batch(ids_q)

        one = assigned.select("id", "vector", "cluster", *(["nearer"] if copies else [])).mapInArrow(run, "query_id long, id long, score double")
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], "query_id long, id long, score double, rank int") if out is None else search.best_of(out, k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, ``recall``: the share of true (query_id, id) pairs that were found."""
    hit = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
