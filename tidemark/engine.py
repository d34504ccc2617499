"""The service as a Python object: state, documents, vectors, events, SQL, chunk search and hybrid search over one folder.

Every change is an event of one log with ascending offsets (see `sources.logstore`); states are folds over the newest
snapshot and the events after it.  One writer at a time is assumed, as changes read the current state first; readers may
be many.  Frames are the way to write at scale (`put_frame`, `upsert_frame`, `delete_frame`): they are decided by joins and
committed as one event range.  After a commit, what `config.Maintenance` asks for is done: snapshots, compaction, training.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import IndexSettings, Limits, Maintenance
from .errors import EngineError, require
from .functions import jsons
from .functions import vectors as V
from .keys import Keys
from .operators import batches, changelog, graph, hybrid, ivf, postings, rag, search, sqlapi
from .sources import events as E
from .sources import runfiles
from .sources.logstore import LOG, LogStore

def now_ms() -> int:
    return time.time_ns() // 1_000_000


class Engine:
    def __init__(self, spark: SparkSession, path: str, limits: Limits | None = None, index: IndexSettings | None = None, maintenance: Maintenance | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.limits, self.settings = limits or Limits.resolve(), (index or IndexSettings()).clamped()
        self.maintenance = maintenance or Maintenance()
        self.files = LogStore(spark, self.path)
        self.state, self.doc, self.vector = State(self), Docs(self), Vectors(self)
        self.events, self.sql, self.rag = Events(self), sqlapi.Tables(spark, f"{self.path}/sql"), Chunks(self)
        self.keys = Keys(self.sql)
        self.counters: dict[str, int] = {"state_writes": 0, "vector_writes": 0, "vector_searches": 0, "doc_writes": 0, "snapshots": 0, "compactions": 0, "trainings": 0}

    # the log

    def log(self) -> DataFrame:
        return self.files.log()

    def last_offset(self) -> int:
        return self.files.last_offset()

    def commit(self, rows: Sequence[Mapping[str, Any]], at: int | None = None) -> list[int]:
        """Append events; their offsets."""
        if not rows:
            return []
        done = self.files.append([{"ts_ms": at if at is not None else now_ms(), "deleted": False} | dict(r) for r in rows])
        self.maintain()
        return done

    def commit_frame(self, rows: DataFrame, order: Sequence[str] = ("collection", "key"), at: int | None = None) -> int:
        """Append a frame of events (columns of the log but offset); their number."""
        stamp = F.lit(at if at is not None else now_ms())
        _, n = self.files.append_frame(rows.withColumn("ts_ms", stamp), order)
        if n:
            self.maintain()
        return n

    def store(self, name: str, collection: str | None = None, keys: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
        """The latest live event of each (collection, key), or of those asked for alone."""
        return self.files.state(name, collection, keys, prefix)

    def health(self) -> dict:
        return {"status": "ok", "last_offset": self.last_offset()}

    def stats(self) -> dict:
        """Health, counters, and what the log, its snapshot and its indexes are."""
        m, commits = self.files.manifest(), self.files.commits()
        indexes = {name: {"kind": x["kind"], "offset": x["offset"]} for name, x in m["indexes"].items()}
        return self.health() | self.counters | {"commits": len(commits), "events": sum(c.events for c in commits), "snapshot_offset": m["snapshot_offset"], "base_offset": m["base_offset"], "indexes": indexes}

    def metrics(self) -> str:
        return "".join(f"tidemark_{k} {v}\n" for k, v in self.counters.items()) + f"tidemark_last_offset {self.last_offset()}\n"

    def maintain(self) -> list[str]:
        """What the settings ask for after a commit: a compaction if there are too many commits or deletions since the last one, else
        a snapshot if there are many since that one; training where enough vectors changed.  What was done."""
        s, m, done = self.maintenance, self.files.manifest(), []
        runs = self.files.commits(m["base_offset"])
        events, gone = sum(c.events for c in runs), sum(c.deleted for c in runs)
        if len(runs) > s.max_commits > 0 or (events >= s.least_events and s.deleted_share > 0 and gone >= s.deleted_share * events):
            self.compact()
            self.retain(s.kept_commits)
            done.append("compact")
        elif s.snapshot_commits and sum(c.last > m["snapshot_offset"] for c in runs) >= s.snapshot_commits:
            self.snapshot()
            done.append("snapshot")
        for name, index in m["indexes"].items():
            # the names of commits bound the changes; only if they are many enough the log is read
            if index["kind"] == "ivf" and sum(c.events for c in self.files.commits(index["offset"])) >= index["settings"]["retrain_min"]:
                changes = self.files.log(index["offset"]).where((F.col("store") == "vector") & (F.col("collection") == name) & ~F.col("deleted")).count()
                settings = IndexSettings(**index["settings"])
                if ivf.needs_training(changes, settings.min_train, True, settings) and self.vector.train(name) is not None:
                    done.append(f"train {name}")
        return done

    def compact(self) -> int:
        """Keep the latest event of each key alone, deleted ones left out; the number of events dropped."""
        self.counters["compactions"] += 1
        return self.files.compact()

    def snapshot(self) -> int:
        """Write the folded state, from which reads begin from now on; the offset up to which it goes."""
        self.counters["snapshots"] += 1
        return self.files.snapshot()

    def retain(self, commits: int = 0) -> int:
        """Remove commits that the compacted log no longer needs, but the newest ``commits``; how many went."""
        return self.files.vacuum(commits)

    # hybrid

    def meta(self, request: Mapping) -> DataFrame:
        """type: vector (the default), sql, or hybrid (both, fused by ranks)."""
        kind = request.get("type", "vector")
        require(kind in ("vector", "sql", "hybrid"), "invalid_argument", f"type: {kind}")

        def vector_leg() -> DataFrame:
            found = self.vector.search(request["collection"], request["vector"], max(int(request.get("k", 10)), 1), request.get("filters"), checked=False)
            return hybrid.ranked(found, F.desc("score"), "id").select("id", "rank", F.to_json(F.struct("id", "score", "meta")).alias("payload"))

        def sql_leg() -> DataFrame:
            rows = self.sql.rows(request["sql"], request.get("params", ()))
            return hybrid.in_order(jsons.json_rows(rows).select(F.get_json_object("row", "$.id").alias("id"), F.col("row").alias("payload")))

        if kind == "vector":
            return vector_leg()
        if kind == "sql":
            return sql_leg()
        return hybrid.fused([vector_leg(), sql_leg()], int(request.get("rrf_k", hybrid.RRF_K)))


class State:
    """Keys with values, revisions and expiry."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def table(self, at: int | None = None, keys: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
        rows = self.engine.store("state", "", keys, prefix).select("key", "value", "revision", "expires_at_ms")
        return changelog.live(rows, at if at is not None else now_ms())

    def get(self, key: str, at: int | None = None) -> dict | None:
        row = self.table(at, [key]).first()
        return row and _item(row)

    def list(self, prefix: str | None = None, limit: int | None = None, at: int | None = None) -> DataFrame:
        limit = min(limit if limit is not None else self.engine.limits.list_default, self.engine.limits.list_cap)
        return self.table(at, prefix=prefix).orderBy("key").limit(limit)

    def put(self, key: str, value: Any, ttl_ms: int | None = None, if_revision: int | None = None, at: int | None = None) -> dict:
        done = self.batch_put([{"key": key, "value": value, "ttl_ms": ttl_ms, "if_revision": if_revision}], at)[0]
        if done["status"] != "ok":
            raise EngineError(done["error"], key)
        return done["item"]

    def batch_put(self, ops: Sequence[Mapping], at: int | None = None) -> list[dict]:
        """A result for each operation, in order; those that fail change nothing.  Later operations see earlier ones."""
        limits, at = self.engine.limits, at if at is not None else now_ms()
        require(len(ops) <= limits.max_state_batch, "invalid_argument", "too many operations")
        keys = list({op["key"] for op in ops})
        now = {r.key: r.revision for r in self.table(at, keys).collect()}
        rows, results = [], []
        for op in ops:
            text = json.dumps(op["value"])
            wanted, have = op.get("if_revision"), now.get(op["key"])
            error = None
            if not op["key"] or len(op["key"]) > limits.max_key_len:
                error = "invalid_argument"
            elif len(text.encode()) > limits.max_json_bytes:
                error = "payload_too_large"
            elif wanted is not None and wanted != have:
                error = "revision_mismatch"
            if error:
                results.append({"key": op["key"], "status": "error", "error": error})
                continue
            ttl = op.get("ttl_ms")
            item = {"key": op["key"], "value": text, "revision": (have or 0) + 1, "expires_at_ms": None if ttl is None else at + ttl}
            now[op["key"]] = item["revision"]
            rows.append(item | {"type": "state_updated", "store": "state", "collection": ""})
            results.append({"key": op["key"], "status": "ok", "item": item | {"value": op["value"]}})
        self.engine.commit(rows, at)
        self.engine.counters["state_writes"] += len(rows)
        return results

    def put_frame(self, ops: DataFrame, at: int | None = None) -> DataFrame:
        """Puts of a frame of any size (key, value as JSON; ttl_ms and if_revision where there are such columns; one row for each
        key): (key, status, revision), see `operators.batches.put`.  What is allowed is committed."""
        limits, at = self.engine.limits, at if at is not None else now_ms()
        done = batches.put(ops, self.table(at), limits.max_key_len, limits.max_json_bytes)
        expires = (F.lit(at) + F.col("ttl_ms")).cast("long") if "ttl_ms" in ops.columns else F.lit(None).cast("long")
        done = done.select("key", "value", "status", "revision", expires.alias("expires_at_ms"))
        # the statuses are of the state before the commit
        done = self.engine.spark.read.schema(done.schema).parquet(self.engine.files.write(done, f"statuses/{uuid.uuid4().hex}"))
        rows = done.where("revision IS NOT NULL").select(F.lit("state_updated").alias("type"), F.lit("state").alias("store"), F.lit("").alias("collection"), "key", "value", "revision", "expires_at_ms")
        self.engine.counters["state_writes"] += self.engine.commit_frame(rows, ("key",), at)
        return done.select("key", "status", "revision")

    def delete(self, key: str, reason: str | None = None, at: int | None = None) -> bool:
        if self.get(key, at) is None:
            return False
        self.engine.commit([{"type": "state_deleted", "store": "state", "collection": "", "key": key, "deleted": True, "reason": reason}], at)
        return True

    def expire(self, at: int | None = None, limit: int = 1000) -> list[str]:
        """Delete what has expired, the longest expired first, with events of reason ``ttl``; the keys."""
        at = at if at is not None else now_ms()
        rows = changelog.due(self.engine.store("state"), at, limit).select("key").collect()
        self.engine.commit([{"type": "state_deleted", "store": "state", "collection": "", "key": r.key, "deleted": True, "reason": "ttl"} for r in rows], at)
        return [r.key for r in rows]


def _item(row) -> dict:
    return {"key": row.key, "value": json.loads(row.value), "revision": row.revision, "expires_at_ms": row.expires_at_ms}


class Docs:
    """JSON documents by collection and id, with an exact-match index over their string fields."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def table(self, collection: str, ids: Sequence[str] | None = None) -> DataFrame:
        rows = self.engine.store("doc", collection, ids)
        return rows.select(F.col("key").alias("id"), F.col("value").alias("doc"), "revision")

    def put(self, collection: str, id: str, doc: Mapping) -> dict:
        require(isinstance(doc, Mapping), "invalid_argument", "a document is an object")
        require(bool(id) and len(id) <= self.engine.limits.max_id_len, "invalid_argument", "id")
        old = self.get(collection, id)
        revision = (old["revision"] if old else 0) + 1
        self.engine.commit([{"type": "state_updated", "store": "doc", "collection": collection, "key": id, "value": json.dumps(doc), "revision": revision}])
        self.engine.counters["doc_writes"] += 1
        return {"id": id, "doc": dict(doc), "revision": revision}

    def get(self, collection: str, id: str) -> dict | None:
        row = self.table(collection, [id]).first()
        return row and {"id": row.id, "doc": json.loads(row.doc), "revision": row.revision}

    def delete(self, collection: str, id: str) -> bool:
        if self.get(collection, id) is None:
            return False
        self.engine.commit([{"type": "state_deleted", "store": "doc", "collection": collection, "key": id, "deleted": True}])
        return True

    def index(self, collection: str) -> DataFrame:
        return postings.build(self.table(collection))

    def find(self, collection: str, filter: Mapping | None = None, limit: int = 20) -> DataFrame:
        limit = min(max(limit, 1), self.engine.limits.max_doc_find)
        docs = self.table(collection)
        if filter is None:
            return docs.orderBy("id").limit(limit)
        return postings.among(docs, self.candidates(collection, filter)).where(jsons.matches(F.col("doc"), dict(filter))).orderBy("id").limit(limit)

    def candidates(self, collection: str, filter: Mapping) -> DataFrame | None:
        """Ids that the index leaves for a filter; None if it can't answer."""
        return self.engine.files.candidates("doc", collection, filter) if postings.usable(dict(filter)) else None


class Vectors:
    """Collections of vectors with JSON metadata."""

    def __init__(self, engine: Engine):
        self.engine = engine

    # catalogue

    def create_collection(self, collection: str, dim: int, metric: str = "cosine", index: IndexSettings | None = None) -> None:
        """``index`` is kept with the collection; without it the engine's settings count."""
        limits = self.engine.limits
        require(0 < len(collection) <= limits.max_collection_len and 0 < dim <= limits.max_dim, "invalid_argument")
        require(metric in ("cosine", "dot"), "invalid_argument", f"metric: {metric}")
        require(self._manifest(collection) is None, "already_exists", collection)
        value = json.dumps({"dim": dim, "metric": metric, "created_at_ms": now_ms(), "index": index and asdict(index.clamped())})
        self.engine.commit([{"type": "vector_collection_created", "store": "collection", "collection": "", "key": collection, "value": value}])

    def _manifest(self, collection: str) -> dict | None:
        row = self.engine.store("collection", "", [collection]).first()
        return row and json.loads(row.value)

    def settings(self, collection: str) -> IndexSettings:
        found = self._need(collection).get("index")
        return IndexSettings(**found) if found else self.engine.settings

    def _need(self, collection: str) -> dict:
        found = self._manifest(collection)
        require(found is not None, "not_found", collection)
        return found

    def list(self) -> DataFrame:
        """Every collection with its manifest and counts, by name."""
        log = self.engine.log().where("store = 'vector'")
        counts = changelog.stats(log, ["collection"], "key", "offset")
        manifests = self.engine.store("collection").select(F.col("key").alias("collection"), F.get_json_object("value", "$.dim").cast("int").alias("dim"), F.get_json_object("value", "$.metric").alias("metric"))
        numbers = ["live", "records", "upserts", "dead", "applied_offset"]
        return batches.catalogue(manifests, counts, numbers).select("collection", "dim", "metric", *numbers)

    def info(self, collection: str) -> dict:
        self._need(collection)
        return self.list().where(F.col("collection") == collection).first().asDict()

    def table(self, collection: str, ids: Sequence[str] | None = None) -> DataFrame:
        rows = self.engine.store("vector", collection, ids)
        return rows.select(F.col("key").alias("id"), "vector", F.col("value").alias("meta"))

    def get(self, collection: str, id: str) -> dict | None:
        self._need(collection)
        row = self.table(collection, [id]).first()
        return row and {"id": row.id, "vector": list(row.vector), "meta": json.loads(row.meta)}

    # changes

    def add(self, collection: str, id: str, vector: Sequence[float], meta: Any = None) -> None:
        self._one(collection, {"id": id, "vector": vector, "meta": meta}, "vector_added", fresh=True)

    def upsert(self, collection: str, id: str, vector: Sequence[float], meta: Any = None) -> None:
        self._one(collection, {"id": id, "vector": vector, "meta": meta}, "vector_upserted")

    def _one(self, collection: str, item: Mapping, type_: str, fresh: bool = False) -> None:
        if fresh:
            require(self.get(collection, item["id"]) is None, "already_exists", item["id"])
        done = self.upsert_batch(collection, [item], type_)[0]
        if done["status"] != "ok":
            raise EngineError(done["error"], item["id"])

    def upsert_batch(self, collection: str, items: Sequence[Mapping], type_: str = "vector_upserted") -> list[dict]:
        """A result for each item; items that fail are left out.  Vectors of a dot collection are brought to unit length."""
        manifest, limits = self._need(collection), self.engine.limits
        require(len(items) <= limits.max_vector_batch, "invalid_argument", "too many items")
        rows, results = [], []
        for item in items:
            vector, meta = [float(x) for x in item["vector"]], json.dumps(item.get("meta"))
            error = "dim_mismatch" if len(vector) != manifest["dim"] else "invalid_argument" if not item["id"] or len(item["id"]) > limits.max_id_len else "payload_too_large" if len(meta.encode()) > limits.max_json_bytes else None
            results.append({"id": item["id"], "status": "error", "error": error} if error else {"id": item["id"], "status": "ok"})
            if not error:
                if manifest["metric"] == "dot":
                    n = sum(x * x for x in vector) ** 0.5
                    vector = [x / n for x in vector] if n else vector
                rows.append({"type": type_, "store": "vector", "collection": collection, "key": item["id"], "vector": vector, "value": meta})
        self.engine.commit(rows)
        self.engine.counters["vector_writes"] += len(rows)
        self._first_training(collection, manifest)
        return results

    def _first_training(self, collection: str, manifest: Mapping) -> None:
        """Train a collection that is to have a cluster index and has none, once it has enough items."""
        settings = IndexSettings(**manifest["index"]) if manifest.get("index") else self.engine.settings
        # the names of commits bound the items; only if there may be enough they are counted
        if settings.kind == "ivf" and not self._index(collection) and sum(c.events for c in self.engine.files.commits()) >= settings.min_train:
            if ivf.needs_training(0, self.table(collection).count(), False, settings):
                self.train(collection)

    def update(self, collection: str, id: str, vector: Sequence[float] | None = None, meta: Any = None) -> None:
        """What is given replaces what is there."""
        old = self.get(collection, id)
        require(old is not None, "not_found", id)
        self._one(collection, {"id": id, "vector": old["vector"] if vector is None else vector, "meta": old["meta"] if meta is None else meta}, "vector_updated")

    def delete(self, collection: str, id: str) -> None:
        done = self.delete_batch(collection, [id])[0]
        if done["status"] != "ok":
            raise EngineError(done["error"], id)

    def delete_batch(self, collection: str, ids: Sequence[str]) -> list[dict]:
        self._need(collection)
        require(len(ids) <= self.engine.limits.max_vector_batch, "invalid_argument", "too many ids")
        have = {r.id for r in self.table(collection, ids).select("id").collect()}
        self.engine.commit([{"type": "vector_deleted", "store": "vector", "collection": collection, "key": i, "deleted": True} for i in dict.fromkeys(ids) if i in have])
        return [{"id": i, "status": "ok"} if i in have else {"id": i, "status": "error", "error": "not_found"} for i in ids]

    def _frame(self, collection: str, rows: DataFrame, type_: str) -> int:
        n = self.engine.commit_frame(rows.withColumns({"type": F.lit(type_), "store": F.lit("vector"), "collection": F.lit(collection)}), ("key",))
        self.engine.counters["vector_writes"] += n
        return n

    def _statuses(self, done: DataFrame) -> DataFrame:
        return self.engine.spark.read.schema(done.schema).parquet(self.engine.files.write(done, f"statuses/{uuid.uuid4().hex}"))

    def upsert_frame(self, collection: str, items: DataFrame, fresh: bool = False) -> DataFrame:
        """Upserts (with ``fresh``: adds) of a frame of any size (id, vector, meta as JSON; one row for each id): (id, status),
        where status is ok, dim_mismatch, invalid_argument, payload_too_large or already_exists.  What is ok is committed."""
        manifest, limits = self._need(collection), self.engine.limits
        bad = (
            F.when(F.coalesce(F.size("vector"), F.lit(-1)) != manifest["dim"], "dim_mismatch")
            .when(F.coalesce(F.length("id"), F.lit(0)).isin(0) | (F.length("id") > limits.max_id_len), "invalid_argument")
            .when(F.octet_length("meta") > limits.max_json_bytes, "payload_too_large")
        )
        rows = items.select("id", F.col("vector").cast("array<float>").alias("vector"), F.coalesce("meta", F.lit("null")).alias("meta"))
        if fresh:
            rows = batches.add(rows, self.table(collection))
        known = F.when(F.col("status") == "already_exists", F.col("status")) if fresh else F.lit(None).cast("string")
        done = self._statuses(rows.withColumn("status", F.coalesce(bad, known, F.lit("ok"))))
        vector = V.l2_normalize(F.col("vector")).cast("array<float>") if manifest["metric"] == "dot" else F.col("vector")
        self._frame(collection, done.where("status = 'ok'").select(F.col("id").alias("key"), vector.alias("vector"), F.col("meta").alias("value")), "vector_added" if fresh else "vector_upserted")
        self._first_training(collection, manifest)
        return done.select("id", "status")

    def export_runs(self, collection: str, path: str, target: int = runfiles.TARGET) -> DataFrame:
        """The live items as run files, with their codes; see `runfiles.write`."""
        self._need(collection)
        items = self.engine.store("vector", collection).select("offset", F.lit(False).alias("deleted"), F.col("key").alias("id"), "vector", F.col("value").alias("meta"))
        return runfiles.write(items.withColumn("scale", V.q8_scale(F.col("vector"))).withColumn("codes", V.q8_codes(F.col("vector"), F.col("scale"))), path, target)

    def import_runs(self, collection: str, path: str, legacy: bool = False) -> DataFrame:
        """Upsert the live items of run files (or older vector files) of the collection's dimension: (id, status)."""
        found = runfiles.state(runfiles.read(self.engine.spark, path, legacy), self._need(collection)["dim"])
        return self.upsert_frame(collection, found.select("id", "vector", "meta"))

    def update_frame(self, collection: str, updates: DataFrame) -> DataFrame:
        """Updates of a frame of any size (id, vector, meta; null: keep): (id, status), ok or not_found."""
        current = self.table(collection)
        done = self._statuses(batches.delete_status(updates.select("id"), current))
        new = batches.update(current, updates, ["vector", "meta"]).where("updated").select(F.col("id").alias("key"), "vector", F.col("meta").alias("value"))
        self._frame(collection, new, "vector_updated")
        return done

    def delete_frame(self, collection: str, ids: DataFrame) -> DataFrame:
        """Deletes of a frame of any size (id): (id, status), ok or not_found."""
        self._need(collection)
        done = self._statuses(batches.delete_status(ids.select("id").distinct(), self.table(collection)))
        self._frame(collection, done.where("status = 'ok'").select(F.col("id").alias("key"), F.lit(True).alias("deleted")), "vector_deleted")
        return done

    # search

    def search(self, collection: str, vector: Sequence[float], k: int, filters: Mapping | None = None, include_meta: bool = True, checked: bool = True, kind: str | None = None) -> DataFrame:
        """(id, score, meta), best first, ties by id, after the filter.

        ``kind`` is exact, ivf or graph, by default the collection's own; where there is no such index, or not one that can
        answer (a graph that changes have outrun, or that would have to filter), the search is exact.
        """
        manifest = self._need(collection)
        require(not checked or 0 < k <= self.engine.limits.max_k, "invalid_argument", f"k: {k}")
        require(len(vector) == manifest["dim"], "dim_mismatch")
        self.engine.counters["vector_searches"] += 1
        kind = kind or self.settings(collection).kind
        index = self._index(collection)
        if kind == "ivf" and index:
            found = self._probe(collection, index, vector, k, filters)
        elif kind == "graph" and not filters and self.graph_status(collection)["available"]:
            found = self._walk(collection, vector, k)
        else:
            items = self.table(collection)
            if filters:
                wanted = dict(filters)
                ids = self.engine.files.candidates("vector", collection, wanted) if postings.usable(wanted) else None
                items = postings.among(items, ids)
            items = items.where(jsons.matches(F.col("meta"), filters if filters is None else dict(filters)))
            found = search.exact(items, search.literal(vector), k, manifest["metric"])
        return found.select("id", "score", "meta") if include_meta else found.select("id", "score")

    # cluster index

    def _index(self, name: str) -> dict | None:
        return self.engine.files.manifest()["indexes"].get(name)

    def _keep(self, name: str, index: dict | None) -> None:
        known = dict(self.engine.files.manifest()["indexes"])
        if index is None:
            known.pop(name, None)
        else:
            known[name] = index
        self.engine.files.switch(indexes=known)

    def train(self, collection: str) -> DataFrame | None:
        """Build the cluster index and keep it: centroids, and the items with their codes laid out by cluster.  The centroids, or
        None if there are too few items."""
        settings, last = self.settings(collection), self.engine.last_offset()
        items = self.table(collection).where(F.size("vector") == self._need(collection)["dim"])
        centroids = ivf.train(items, settings)
        if centroids is None:
            return None
        folder = f"{self.engine.path}/index/{uuid.uuid4().hex}"
        centroids.coalesce(1).write.parquet(f"{folder}/centroids")
        kept = self.engine.spark.read.schema(centroids.schema).parquet(f"{folder}/centroids")
        assigned = ivf.assign(items, kept, settings.copies)
        if "nearer" not in assigned.columns:
            assigned = assigned.withColumn("nearer", F.array().cast("array<int>"))
        ivf.write(ivf.coded(assigned), f"{folder}/items")
        self._keep(collection, {"kind": "ivf", "folder": folder, "offset": last, "settings": asdict(settings.clamped())})
        self.engine.counters["trainings"] += 1
        return kept

    def _probe(self, collection: str, index: dict, vector: Sequence[float], k: int, filters: Mapping | None) -> DataFrame:
        """The index's clusters next to the query, and exactly what changed since it was built."""
        settings, spark = IndexSettings(**index["settings"]), self.engine.spark
        query = search.literal(vector)
        items = spark.read.schema(ivf.LAYOUT).parquet(f"{index['folder']}/items")
        centroids = spark.read.schema("cluster int, centroid array<double>").parquet(f"{index['folder']}/centroids")
        changed = self.engine.files.changed("vector", collection, index["offset"])
        wanted = jsons.matches(F.col("meta"), filters if filters is None else dict(filters))
        near = ivf.near(items, centroids, query, settings).join(changed.select(F.col("key").alias("id")), "id", "left_anti").where(wanted)
        fresh = changed.where(~F.col("deleted")).select(F.col("key").alias("id"), "vector", F.col("value").alias("meta")).where(wanted)
        old = ivf.shortlisted(near, query, max(settings.refine, k)).select("id", "vector", "meta")
        return search.exact(old.unionByName(fresh), query, k)

    def index_status(self, collection: str) -> dict:
        """Whether there is a cluster index, and how many items changed since it was built."""
        index = self._index(collection)
        if not index:
            return {"available": False}
        return {"available": True, "offset": index["offset"], "changed": self.engine.files.changed("vector", collection, index["offset"]).count()} | index["settings"]

    def drop_index(self, collection: str) -> None:
        self._keep(collection, None)

    # graph index

    def build_graph(self, collection: str, degree: int = 48, search_list: int = 128) -> dict:
        settings = IndexSettings(kind="graph", degree=degree, search_list=search_list).clamped()
        last, dim = self.engine.last_offset(), self._need(collection)["dim"]
        folder = f"{self.engine.path}/graph/{uuid.uuid4().hex}"
        graph.write(graph.build(self.table(collection).where(F.size("vector") == dim), settings), folder)
        self._keep(f"{collection}/graph", {"kind": "graph", "folder": folder, "offset": last, "settings": asdict(settings)})
        return self.graph_status(collection)

    def tune_graph(self, collection: str, search_list: int) -> dict:
        index = self._index(f"{collection}/graph")
        require(index is not None, "not_found", collection)
        settings = IndexSettings(**(index["settings"] | {"search_list": search_list})).clamped()
        self._keep(f"{collection}/graph", index | {"settings": asdict(settings)})
        return self.graph_status(collection)

    def graph_status(self, collection: str) -> dict:
        """Whether the graph is there and no vector has changed since."""
        index = self._index(f"{collection}/graph")
        if not index:
            return {"available": False}
        changed = self.engine.files.changed("vector", collection, index["offset"])
        return {"available": changed.isEmpty(), "degree": index["settings"]["degree"], "search_list": index["settings"]["search_list"]}

    def drop_graph(self, collection: str) -> None:
        self._keep(f"{collection}/graph", None)

    def _walk(self, collection: str, vector: Sequence[float], k: int) -> DataFrame:
        index = self._index(f"{collection}/graph")
        found = graph.topk(graph.read(self.engine.spark, index["folder"]), search.literal(vector), k, IndexSettings(**index["settings"]))
        # k rows
        rows = {r.id: r.score for r in found.collect()}
        meta = self.table(collection, list(rows)).select("id", "meta")
        scores = self.engine.spark.createDataFrame(list(rows.items()), "id string, score double")
        return search.top(scores.join(meta, "id"), k)

    def graph_search(self, collection: str, vector: Sequence[float], k: int) -> DataFrame:
        """Through the graph if it is available, else exactly."""
        return self.search(collection, vector, k, include_meta=False, kind="graph")


class Events:
    """The log as events, with filters."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def read(self, since: int = 0, types: str | None = None, key_prefix: str | None = None, collection: str | None = None) -> DataFrame:
        out = self.engine.files.log(since)
        if types is not None:
            out = out.where(F.col("type").isin([t.strip() for t in types.split(",") if t.strip()]))
        if key_prefix is not None:
            out = out.where(F.col("key").startswith(key_prefix))
        if collection is not None:
            out = out.where(F.col("collection") == collection)
        return out.orderBy("offset")

    def frames(self, since: int = 0, types: str | None = None, key_prefix: str | None = None, collection: str | None = None) -> DataFrame:
        """(offset, frame): the same as server-sent events, see `sources.events.frames`."""
        data = F.to_json(F.struct("collection", "key", "value", "vector", "revision", "expires_at_ms", "reason"))
        return E.frames(self.read(since, types, key_prefix, collection).select("offset", "ts_ms", "type", data.alias("data"))).orderBy("offset")

    def stream(self, since: int = 0) -> DataFrame:
        """The same log as it grows."""
        return self.engine.spark.readStream.schema(LOG).parquet(f"{self.engine.path}/log/*").where(F.col("offset") > since)


class Chunks:
    """The chunk log and its search."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _path(self) -> str:
        return f"{self.engine.path}/chunks"

    def ingest(self, chunks: DataFrame) -> None:
        """Append chunks (id, vector, content, metadata); offsets ascend in the order of rows."""
        last = self.table().agg(F.max("offset")).first()[0]
        numbered = chunks.withColumn("offset", F.monotonically_increasing_id() + (0 if last is None else last + 1))  # ascending, with holes
        numbered.select("offset", "id", "vector", "content", "metadata").write.mode("append").parquet(self._path())

    def table(self) -> DataFrame:
        jvm = self.engine.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self._path())
        fs = folder.getFileSystem(self.engine.spark.sparkContext._jsc.hadoopConfiguration())
        return self.engine.spark.read.schema(rag.CHUNK).parquet(self._path()) if fs.exists(folder) else self.engine.spark.createDataFrame([], rag.CHUNK)

    def search(self, text: str, top_k: int = 10, **options: Any) -> DataFrame:
        """Chunks nearest to a text (see `functions.vectors.embed`); options are those of `operators.rag.search`."""
        limits = self.engine.limits
        require(0 < top_k <= limits.max_k, "invalid_argument", f"top_k: {top_k}")
        require(0 < len(text.encode()) <= limits.max_query_bytes, "invalid_argument", "query")
        query = self.engine.spark.range(1).select(V.embed(F.lit(text)).alias("v")).first().v
        return rag.search(self.table(), search.literal(query), top_k, **options)
