"""One face for the engine's parts: add, search and delete by collection (or table) and id, health and stats."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .errors import EngineError, require


class BaseEngine(Protocol):
    """What the hybrid engine needs of a part."""

    def add(self, collection: str, id: str, value: Mapping) -> None: ...
    def search(self, collection: str, request: Mapping) -> DataFrame: ...
    def delete(self, collection: str, id: str) -> bool: ...
    def health(self) -> dict: ...
    def stats(self) -> dict: ...


class VectorIndex(Protocol):
    """What an index over vectors offers: built from a collection, asked for the nearest, dropped."""

    def train(self, collection: str) -> DataFrame | None: ...
    def search(self, collection: str, vector: Sequence[float], k: int, filters: Mapping | None = None) -> DataFrame: ...
    def drop_index(self, collection: str) -> None: ...


class VectorPart:
    """Vectors: a value is {"vector", "meta"}, a request {"vector", "k", "filters"}."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def add(self, collection: str, id: str, value: Mapping) -> None:
        self.engine.vector.add(collection, id, value["vector"], value.get("meta"))

    def search(self, collection: str, request: Mapping) -> DataFrame:
        return self.engine.vector.search(collection, request["vector"], max(int(request.get("k", 10)), 1), request.get("filters"), checked=False)

    def delete(self, collection: str, id: str) -> bool:
        try:
            self.engine.vector.delete(collection, id)
        except EngineError as e:
            if e.code == "not_found":
                return False
            raise
        return True

    def health(self) -> dict:
        return self.engine.health()

    def stats(self) -> dict:
        return {"collections": self.engine.vector.list().count()} | self.engine.stats()


class TablePart:
    """Tables: a value is a row by column name, a request {"sql", "params"} or the columns that a row must equal; ids are in the
    column id."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def add(self, collection: str, id: str, value: Mapping) -> None:
        from .operators.sqlapi import parameters

        names = list(value)
        row = self.engine.spark.createDataFrame([tuple(parameters(list(value.values())))], ", ".join(f"`{c}` {_kind(value[c])}" for c in names))
        self.engine.sql.insert(collection, row)

    def search(self, collection: str, request: Mapping) -> DataFrame:
        from .operators.sqlapi import equal_rows

        if "sql" in request:
            return self.engine.sql.rows(request["sql"], request.get("params", ()))
        return equal_rows(self.engine.sql.read(collection), dict(request))

    def delete(self, collection: str, id: str) -> bool:
        return self.engine.sql.delete(collection, {"id": id}) > 0

    def health(self) -> dict:
        return {"status": "ok", "tables": len(self.engine.sql.names())}

    def stats(self) -> dict:
        return {t: self.engine.sql.read(t).count() for t in self.engine.sql.names()}


class DocumentPart:
    """Documents: a value is the document, a request {"filter", "limit"}."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def add(self, collection: str, id: str, value: Mapping) -> None:
        self.engine.doc.put(collection, id, value)

    def search(self, collection: str, request: Mapping) -> DataFrame:
        return self.engine.doc.find(collection, request.get("filter"), int(request.get("limit", 20)))

    def delete(self, collection: str, id: str) -> bool:
        return self.engine.doc.delete(collection, id)

    def health(self) -> dict:
        return self.engine.health()

    def stats(self) -> dict:
        rows = self.engine.store("doc").groupBy("collection").agg(F.count("*").alias("n")).collect()  # a row for each collection
        return {r.collection: r.n for r in rows}


def parts(engine: Engine) -> dict[str, BaseEngine]:
    return {"vector": VectorPart(engine), "sql": TablePart(engine), "doc": DocumentPart(engine)}


def _kind(value: Any) -> str:
    require(value is None or isinstance(value, bool | int | float | str), "invalid_argument", json.dumps(str(value)))
    return "long" if isinstance(value, bool | int) else "double" if isinstance(value, float) else "string"
