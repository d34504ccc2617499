"""Folds over change logs: latest row of a key, key-value state with revisions and expiry, compaction, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: Column | str, *, tombstone: Column | None = None) -> DataFrame:
    """The row of each key with the largest ``order`` (unique in a key); rows of which ``tombstone`` holds end the key.

    An aggregate, not a window: max_by is summed up before the shuffle, so a hot key costs a row for each task.
    """
    names = log.columns
    rest = [c for c in names if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order if isinstance(order, Column) else F.col(order)).alias("__row"))
    # keys come from the grouping, not from the struct, so that filters on them reach the scan
    out = best.select(*(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in names))
    return out if tombstone is None else out.where(~F.coalesce(tombstone, F.lit(False)))


def revisions(log: DataFrame, key: str = "key", offset: str = "offset", deleted: str = "deleted", width: int = 1 << 16) -> DataFrame:
    """``log`` with ``revision``: 1 for the first put of a key, one more for each further put, and 1 again after a delete.
    Deletes have a revision of null.

    A put's revision is the puts up to it less the puts up to the last delete before it.  A key's history is cut into
    blocks of ``width`` offsets: running counts are taken within blocks, and what blocks before come to is added, so a
    task sees a block of a hot key and not all of it.
    """
    cut = log.withColumn("__block", F.floor(F.col(offset) / width))
    inside = Window.partitionBy(key, "__block").orderBy(offset)
    put = (~F.col(deleted)).cast("long")
    own = cut.withColumn("__own", F.sum(put).over(inside)).withColumn("__own_last", F.max(F.when(F.col(deleted), F.col("__own"))).over(inside))
    blocks = cut.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__at")).agg(F.sum(put).alias("__puts"))
    # the puts of a block up to its last delete
    lasts = own.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__at")).agg(F.max("__own_last").alias("__last"))
    upto = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(lasts, ["__key", "__at"]).withColumn("__before", F.coalesce(F.sum("__puts").over(upto), F.lit(0)))
    blocks = blocks.withColumn("__cleared", F.coalesce(F.max(F.col("__before") + F.col("__last")).over(upto), F.lit(0)))
    held = own.join(blocks, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__at")))
    last = F.greatest(F.col("__cleared"), F.coalesce(F.col("__before") + F.col("__own_last"), F.lit(0)))
    return held.select(*log.columns, F.when(~F.col(deleted), F.col("__before") + F.col("__own") - last).alias("revision"))


def live(state: DataFrame, now_ms: int | Column, column: str = "expires_at_ms") -> DataFrame:
    """Rows that haven't expired: no expiry, or one after ``now_ms``."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return state.where(F.col(column).isNull() | (F.col(column) > now))


def due(state: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Expired rows, the longest expired first, then by key."""
    out = state.where(F.col("expires_at_ms") <= now_ms).orderBy("expires_at_ms", "key")
    return out.limit(limit) if limit is not None else out


def stats(log: DataFrame, keys: list[str], id_column: str, order: str, deleted: str = "deleted") -> DataFrame:
    """Of each collection: all records, upserts, live ids, records that are no longer live, tombstones and their share,
    and the largest offset."""
    state = latest(log, [*keys, id_column], order)
    now = state.groupBy(*keys).agg(F.count_if(~F.col(deleted)).alias("live"))
    every = log.groupBy(*keys).agg(
        F.count("*").alias("records"), F.count_if(~F.col(deleted)).alias("upserts"), F.count_if(F.col(deleted)).alias("tombstones"), F.max(order).alias("applied_offset")
    )
    out = every.join(now, keys) if keys else every.crossJoin(F.broadcast(now))
    dead = F.greatest(F.col("records") - F.col("live"), F.lit(0))
    return out.withColumn("dead", dead).withColumn("tombstone_ratio", F.when(F.col("records") > 0, F.col("tombstones") / F.col("records")).otherwise(F.lit(0.0)))


def needs_compaction(runs: DataFrame, retention: int, ratio: float) -> DataFrame:
    """One row, ``compact``: whether there are more runs than ``retention``, or the share of tombstones reaches ``ratio``
    (0: that doesn't count).  ``runs`` has records and tombstones of each run."""
    share = F.coalesce(F.try_divide(F.sum("tombstones"), F.sum("records")), F.lit(0.0))
    return runs.agg(((F.count("*") > retention) | (F.lit(ratio > 0) & (share >= ratio))).alias("compact"))


def compacted(log: DataFrame, keys: list[str], id_column: str, order: str, deleted: str = "deleted") -> DataFrame:
    """The live rows alone, in files sorted by id."""
    rows = latest(log, [*keys, id_column], order, tombstone=F.col(deleted))
    return rows.repartition(*(keys or [id_column])).sortWithinPartitions(*keys, id_column) if keys else rows.repartitionByRange(id_column).sortWithinPartitions(id_column)


def gaps(log: DataFrame, offset: str = "offset", partitions: int | None = None, width: int = 1 << 20) -> DataFrame:
    """(from_offset, to_offset, dropped) of each hole between consecutive offsets.

    Offsets are cut into ranges of ``width`` (or into so many ``partitions``), gaps are found within each, and the ends of the
    ranges are compared: a task sees a range, and one the ends of all, a row for each ``width`` offsets.
    """
    low = 0
    if partitions is not None:
        span = log.agg(F.min(offset).alias("lo"), F.max(offset).alias("hi")).first()
        low = span.lo or 0
        width = ((span.hi or 0) - low) // partitions + 1
    ranged = log.select(F.col(offset).alias("o"), F.floor((F.col(offset) - low) / width).alias("cell"))
    inside = ranged.withColumn("before", F.lag("o").over(Window.partitionBy("cell").orderBy("o"))).select("before", "o")
    ends = ranged.groupBy("cell").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.orderBy("cell"))).select("before", F.col("first").alias("o"))
    holes = inside.union(between).where("o - before > 1")
    return holes.select((F.col("before") + 1).alias("from_offset"), (F.col("o") - 1).alias("to_offset"), (F.col("o") - F.col("before") - 1).alias("dropped"))
