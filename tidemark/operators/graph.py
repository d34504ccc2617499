"""Graph index: neighbour tables of regions of the space, searched best-first from the regions next to a query.

Items are cut into regions of about ``SUBGRAPH`` by their nearest centroid.  Each region links its items to their most
similar ones, pruned for diversity, and is a folder of its own once written; a small table has each region's
centroid and reach.  A search reads the regions whose centroids are next to the query alone, walks each from its medoid and
scores no node but those that it visits.  An exact search goes on from the walk's k-th score: it looks for better items in all
regions but those whose reach rules them out, so its result is that of brute force.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexSettings
from ..session import ship
from . import ivf, search

# fixed values
NEAR = 0.98

#: Items of a region; its similarity matrix has this size squared.
SUBGRAPH = 2048
#: Items from which the regions' centroids are learned.
SAMPLE = 100_000
#: Walks and bounds are trusted to so many units of a score; the exact arithmetic of `search` decides within.
SLACK = 1e-6


class Graph(NamedTuple):
    """nodes: part, n, id, vector, neighbours (numbers n of the same part), entry; regions: part, centroid, reach (the largest angle
    between it and a vector of the region)."""

    nodes: DataFrame
    regions: DataFrame


def prune(similarity: np.ndarray, own: np.ndarray, degree: int) -> list[int]:
    """Of candidates by similarity downwards (``own``; ``similarity`` is theirs among each other), the places of those that
    no kept one makes redundant (similarity to it at least NEAR times the candidate's own); filled up to half the degree
    with the nearest of the others."""
    kept: list[int] = []
    free = np.ones(len(own), dtype=bool)
    while len(kept) < degree and free.any():
        j = int(free.argmax())
        kept.append(j)
        free &= similarity[:, j] < NEAR * own
        free[: j + 1] = False
    if len(kept) < (least := max(degree // 2, 1)):
        others = np.ones(len(own), dtype=bool)
        others[kept] = False
        kept += np.flatnonzero(others)[: least - len(kept)].tolist()
    return kept


def _regions(items: DataFrame) -> DataFrame:
    """``items`` with ``part``; a region that comes out too large (as of equal vectors) is split by a hash of the id."""
    wanted = -(-items.count() // SUBGRAPH)
    if wanted <= 1:
        return items.withColumn("part", F.lit(0))
    sample = items.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"].tolist()
    found = ivf.kmeans(np.array(sample), wanted)
    centroids = items.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(found)], "cluster int, centroid array<double>")
    cut = ivf.assign(items, centroids)
    sizes = {r.cluster: r.n for r in cut.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row for each region
    splits = {c: -(-n // (2 * SUBGRAPH)) for c, n in sizes.items()}
    widest = max(splits.values())
    pieces = F.create_map(*(F.lit(x) for c, n in splits.items() for x in (c, n)))[F.col("cluster")]
    return cut.withColumn("part", (F.col("cluster") * widest + F.pmod(F.xxhash64("id"), pieces)).cast("int")).drop("cluster")


def build(items: DataFrame, settings: IndexSettings) -> DataFrame:
    """(part, n, id, vector, neighbours, entry) of ``items`` (id, vector); ``entry`` marks a region's medoid."""
    s = settings.clamped()
    ship(items.sparkSession)
    kind = items.schema["id"].dataType.simpleString()

    def run(_, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        x = np.array(frame["vector"].tolist(), dtype=np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
        sim = x @ x.T
        links: list[set[int]] = [set() for _ in range(len(x))]
        for i in range(len(x)):
            near = np.argsort(-sim[i], kind="stable")
            near = near[near != i][: s.search_list]
            for j in near[prune(sim[np.ix_(near, near)], sim[i, near], s.degree)].tolist():
                links[i].add(j)
                links[j].add(i)
        medoid = int((sim @ np.ones(len(x))).argmax())
        return pd.DataFrame({"part": frame["part"], "n": np.arange(len(x)), "id": frame["id"], "vector": frame["vector"], "neighbours": [sorted(v) for v in links], "entry": np.arange(len(x)) == medoid})

    cut = _regions(items.select("id", "vector")).select("part", "id", "vector")
    return cut.groupBy("part").applyInPandas(run, f"part int, n int, id {kind}, vector array<float>, neighbours array<int>, entry boolean")


def regions(nodes: DataFrame) -> DataFrame:
    """(part, centroid, reach): the mean direction of each region, and how far its vectors are from it."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["vector"].tolist(), dtype=np.float64)
        centroid = x.mean(axis=0)
        both = np.linalg.norm(x, axis=1) * np.linalg.norm(centroid)
        # without a direction nothing is ruled out
        reach = float(np.arccos(np.clip(x @ centroid / both, -1, 1)).max()) if both.min() > 0 else math.pi
        return pd.DataFrame({"part": [key[0]], "centroid": [centroid], "reach": [reach]})

    return nodes.select("part", "vector").groupBy("part").applyInPandas(run, "part int, centroid array<double>, reach double")


def write(nodes: DataFrame, path: str) -> None:
    nodes.write.partitionBy("part").parquet(f"{path}/nodes")
    regions(nodes.sparkSession.read.parquet(f"{path}/nodes")).coalesce(1).write.parquet(f"{path}/regions")


def read(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/regions"))


def routed(graph: Graph, q: np.ndarray) -> list[int]:
    """The regions to walk, those next to a query: a fifth of them, but eight at least."""
    rows = graph.regions.collect()  # a row for each region
    score = {r.part: float(np.dot(r.centroid, q) / max(np.linalg.norm(r.centroid), 1e-300)) for r in rows}
    return sorted(score, key=lambda p: (-score[p], p))[: max(8, math.ceil(len(rows) / 5))]


def within(graph: Graph, q: np.ndarray, least: float) -> list[int]:
    """The regions that may hold a vector whose similarity to the query is ``least`` or more."""
    length, out = float(np.linalg.norm(q)), []
    for r in graph.regions.collect():  # a row for each region
        both = length * float(np.linalg.norm(r.centroid))
        angle = math.acos(min(max(float(np.dot(r.centroid, q)) / both, -1), 1)) if both > 0 else 0.0
        if math.cos(max(angle - r.reach, 0)) >= least:
            out.append(r.part)
    return out


def topk(graph: Graph | DataFrame, query: Column, k: int, settings: IndexSettings, exact: bool = False) -> DataFrame:
    """Best-first search of the regions next to the query, keeping the ``search_list`` best nodes of each.

    With ``exact`` the k-th score of the walk is a bound that the nodes it has missed are held against, and all that is found
    is ranked by `search.exact`: the k best items, of equal scores those with the smallest ids.
    """
    s = settings.clamped()
    if isinstance(graph, DataFrame):
        graph = Graph(graph, regions(graph))
    nodes = graph.nodes
    q = np.array(nodes.sparkSession.range(1).select(query.alias("q")).first().q, dtype=np.float64)
    kind = nodes.schema["id"].dataType.simpleString()
    length = float(np.linalg.norm(q))

    def run(_, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n", ignore_index=True)
        vectors, neighbours, known = frame["vector"], frame["neighbours"], {}

        def score(i: int) -> float:
            if i not in known:
                x = np.asarray(vectors.iloc[i], dtype=np.float64)
                both = float(np.linalg.norm(x)) * length
                known[i] = float(x @ q) / both if both > 0 else 0.0
            return known[i]

        best = np.flatnonzero(frame["entry"].to_numpy()).tolist()
        done: set[int] = set()
        while open_ := [j for j in best if j not in done]:
            i = open_[0]  # ``best`` is in order
            done.add(i)
            best = sorted({*best, *map(int, neighbours.iloc[i])}, key=lambda j: (-score(j), j))[: max(s.search_list, k)]
        out = best[:k]
        return pd.DataFrame({"id": frame["id"].iloc[out].to_numpy(), "score": [score(i) for i in out], "vector": vectors.iloc[out].to_numpy()})

    hits = nodes.where(F.col("part").isin(routed(graph, q))).groupBy("part").applyInPandas(run, f"id {kind}, score double, vector array<float>")
    best = search.top(hits, k)
    if not exact:
        return best.select("id", "score")
    walked = best.collect()  # k rows
    least = walked[-1].score - SLACK if len(walked) == k else -math.inf
    rest = nodes.where(F.col("part").isin(within(graph, q, least)) & ~F.col("id").isin([r.id for r in walked])).select("id", "vector")
    missed = search.scores(rest, query).where(F.col("score") >= least).select("id", "vector")
    known = nodes.sparkSession.createDataFrame([(r.id, r.vector) for r in walked], f"id {kind}, vector array<float>")
    return search.exact(known.union(missed), query, k).select("id", "score")
