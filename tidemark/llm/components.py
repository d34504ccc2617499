"""Connected components of a link table, distributed: alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour (itself included)."""
    least = links.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
    return links.join(least, links.a == least.u, "left").select(F.coalesce("m", "a").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the node's smallest neighbour."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    near = links.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return near.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one."""
    ends = links.selectExpr("b AS node", "1 AS up", "0 AS down").union(links.selectExpr("a AS node", "0 AS up", "1 AS down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node that has a link; the component is its smallest node.

    ``links`` has columns a and b, any direction, repeats allowed.  A hub's rows are spread: the rounds aggregate with
    partial sums and join on the node, where skewed partitions are split at run time.  Each round is a written table.
    """
    links = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not _stars(links):
        starred = scratch.write(_small_star(_large_star(links)), "links")
        scratch.drop(links)
        links = starred
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
