"""Changes as frames: what a batch of puts, adds, updates and deletes does to a table of current rows, decided by joins.

Each function takes a frame of changes and one of current rows, one row for each key in both, and returns a frame; no
row passes the driver.  The engine commits what they allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def put(ops: DataFrame, state: DataFrame, max_key: int, max_bytes: int) -> DataFrame:
    """``ops`` (key, value, if_revision and others) with status and revision.

    status is invalid_argument (no key, or a long one), payload_too_large, revision_mismatch (if_revision is given and
    isn't that of the key, or there is none), created or updated; revision is the new one, null where nothing changes.
    ``state`` has key and revision.
    """
    both = ops.join(state.select("key", F.col("revision").alias("__have")), "key", "left")
    wanted = F.col("if_revision") if "if_revision" in ops.columns else F.lit(None).cast("long")
    status = (
        F.when(F.coalesce(F.length("key"), F.lit(0)).isin(0) | (F.length("key") > max_key), "invalid_argument")
        .when(F.octet_length("value") > max_bytes, "payload_too_large")
        .when(wanted.isNotNull() & ~wanted.eqNullSafe(F.col("__have")), "revision_mismatch")
        .when(F.col("__have").isNotNull(), "updated")
        .otherwise("created")
    )
    out = both.withColumn("status", status)
    return out.withColumn("revision", F.when(F.col("status").isin("created", "updated"), F.coalesce("__have", F.lit(0)) + 1)).drop("__have")


def compared(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """``wanted`` (key, wanted) with the key's revision and whether they agree: ok or revision_mismatch."""
    ok = F.col("revision").eqNullSafe(F.col("wanted"))
    return wanted.join(state.select("key", "revision"), "key", "left").withColumn("status", F.when(ok, "ok").otherwise("revision_mismatch"))


def add(incoming: DataFrame, current: DataFrame, id_: str = "id") -> DataFrame:
    """``incoming`` with status: added, or already_exists where ``current`` has the id."""
    both = incoming.join(current.select(id_, F.lit(True).alias("__there")), id_, "left")
    return both.withColumn("status", F.when(F.col("__there"), "already_exists").otherwise("added")).drop("__there")


def update(current: DataFrame, updates: DataFrame, columns: list[str], id_: str = "id") -> DataFrame:
    """``current`` with what ``updates`` (id and ``columns``) gives in place of what was there, where it isn't null; updated tells
    the rows that an update named."""
    new = updates.select(id_, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    both = current.join(new, id_, "left")
    return both.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns), F.coalesce("__hit", F.lit(False)).alias("updated"))


def delete(current: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    """``current`` without the rows that ``ids`` names."""
    return current.join(ids.select(id_).distinct(), id_, "left_anti")


def delete_status(ids: DataFrame, current: DataFrame, id_: str = "id") -> DataFrame:
    """``ids`` with status: ok, or not_found."""
    both = ids.join(current.select(id_, F.lit(True).alias("__there")), id_, "left")
    return both.withColumn("status", F.when(F.col("__there"), "ok").otherwise("not_found")).drop("__there")


def catalogue(manifests: DataFrame, stats: DataFrame, zeros: list[str], name: str = "collection") -> DataFrame:
    """Every collection that has a manifest or rows, with both; numbers of rows are 0 where there are none."""
    there = manifests.withColumn("has_manifest", F.lit(True))
    both = there.join(stats, name, "full_outer")
    out = [F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in zeros else F.coalesce("has_manifest", F.lit(False)).alias(c) if c == "has_manifest" else F.col(c) for c in both.columns]
    return both.select(*out).orderBy(name)


def collection_stats(items: DataFrame, norm: Column, by: str) -> DataFrame:
    """live, first_id, last_id, dim and mean_norm of each collection."""
    return items.groupBy(by).agg(
        F.count("*").alias("live"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max(F.size("vector")).alias("dim"), F.round(F.avg(norm), 6).alias("mean_norm")
    )


def event_metrics(log: DataFrame, key: str = "key") -> DataFrame:
    """n, keys, first_offset and last_offset of each type of event."""
    return log.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def first_of_each(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__rank = 1").drop("__rank")
