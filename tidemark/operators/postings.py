"""Exact-match index: (collection, field, value, id) of the string fields of JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsons


def build(docs: DataFrame, column: str = "doc", *keep: str) -> DataFrame:
    """The entries of ``docs`` (id, a JSON text in ``column``, and ``keep``)."""
    return jsons.string_fields(docs, column, *keep, "id").withColumnsRenamed({"key": "field"})


def lists(index: DataFrame) -> DataFrame:
    """(field, value, ids): sorted, without repeats."""
    return index.groupBy("field", "value").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def usable(wanted: dict) -> bool:
    """Whether the index answers a filter: it has fields, all with string values."""
    return bool(wanted) and all(isinstance(v, str) for v in wanted.values())


def candidates(index: DataFrame, wanted: dict) -> DataFrame:
    """Ids that have every field with its value."""
    if not usable(wanted):
        raise ValueError("the index knows string values alone")
    hit = reduce(lambda a, b: a | b, ((F.col("field") == k) & (F.col("value") == v) for k, v in wanted.items()))
    return index.where(hit).select("id", "field").distinct().groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")


def among(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``rows`` whose id is among ``ids``; all of them if those are None."""
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def find(docs: DataFrame, index: DataFrame | None, wanted: dict, limit: int, column: str = "doc") -> DataFrame:
    """Documents that match ``wanted``, by id: through the index where it answers, and in any case by the predicate itself."""
    rows = among(docs, candidates(index, wanted) if index is not None and usable(wanted) else None)
    return rows.where(jsons.matches(F.col(column), wanted)).orderBy("id").limit(max(limit, 1))
