"""The engine's log on a store of files: commits, an atomic manifest, snapshots of the folded state, compaction, vacuum.

Layout below a folder: ``log/`` has a Parquet folder for each commit, named by its first offset and its numbers of events
and of deletions, so offsets and maintenance need no read; ``state/`` has snapshots, the latest live event of each key, sorted by
store, collection and key, so that a point read skips all other row groups, each with the postings of its documents'
string fields; ``versions/`` has manifests, of which the newest counts.  A commit, a snapshot or a manifest becomes visible by
one rename; there is no moment without a readable version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons
from ..operators import changelog

LOG = "offset long, ts_ms long, type string, store string, collection string, key string, value string, vector array<float>, expires_at_ms long, revision long, deleted boolean, reason string"
NAMES = [f.split()[0] for f in LOG.split(", ")]
POSTINGS = "store string, collection string, field string, value string, id string"
#: Stores whose values are JSON documents with an exact-match index.
INDEXED = ("doc", "vector")


class Commit(NamedTuple):
    first: int
    events: int
    deleted: int
    name: str

    @property
    def last(self) -> int:
        return self.first + self.events - 1


class LogStore:
    """One writer at a time; readers may be many, and see a version as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _names(self, folder: str) -> list[str]:
        at = self._new(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))) if self._fs.exists(at) else []

    def _move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._new(target).getParent())
        if self._fs.exists(self._new(target)) or not self._fs.rename(self._new(source), self._new(target)):
            raise RuntimeError(f"another writer was faster: {target}")

    def write(self, rows: DataFrame, target: str) -> str:
        """``rows`` as the folder ``target``, all or nothing; its path."""
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        self._move(staged, f"{self.path}/{target}")
        return f"{self.path}/{target}"

    def manifest(self) -> dict[str, Any]:
        """high: an offset that was given out; base: a snapshot that stands for all events up to base_offset; snapshot: the
        newest snapshot, of the events up to snapshot_offset; indexes: what is known of vector indexes, by name."""
        found = self._names("versions")
        default = {"version": 0, "high": 0, "base": None, "base_offset": 0, "snapshot": None, "snapshot_offset": 0, "indexes": {}}
        if not found:
            return default
        stream = self._fs.open(self._new(f"{self.path}/versions/{found[-1]}"))
        try:
            return default | json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def switch(self, **changes: Any) -> dict[str, Any]:
        """A new manifest; it counts from the rename on."""
        new = self.manifest() | changes
        new["version"] += 1
        staged = f"{self.path}/staging/{uuid.uuid4().hex}.json"
        out = self._fs.create(self._new(staged))
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self._move(staged, f"{self.path}/versions/{new['version']:012d}.json")
        return new

    # commits

    def commits(self, above: int = 0) -> list[Commit]:
        """Those with events above an offset, in order."""
        parts = (name.split("-") for name in self._names("log"))
        found = (Commit(int(p[0]), int(p[1]), int(p[2]), "-".join(p)) for p in parts)
        return [c for c in found if c.last > above]

    def last_offset(self) -> int:
        """The largest offset that was ever given out, whether its event is still there or not."""
        return max(self.manifest()["high"], max((c.last for c in self.commits()), default=0))

    def append(self, rows: Sequence[Mapping[str, Any]]) -> list[int]:
        first = self.last_offset() + 1
        full = [dict(r) | {"offset": first + i} for i, r in enumerate(rows)]
        frame = self.spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in full], LOG).coalesce(1)
        self.write(frame, f"log/{first:018d}-{len(full)}-{sum(bool(r.get('deleted')) for r in full)}-{uuid.uuid4().hex[:8]}")
        return [r["offset"] for r in full]

    def append_frame(self, rows: DataFrame, order: Sequence[str]) -> tuple[int, int]:
        """Append a frame of events (columns of LOG but offset; missing ones are null) in the order of ``order``, distributed; the
        first offset and the number of events.

        Offsets follow from the rows' numbers within sorted parts and the parts' sizes, so no task sees all rows.
        """
        names = [f.split(" ", 1) for f in LOG.split(", ")]
        full = rows.select(*(F.col(n).cast(t).alias(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in names if n != "offset"))
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        full.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(staged)
        held = self.spark.read.schema(full.withColumn("__at", F.lit(0).cast("long")).schema).parquet(staged)
        part = F.shiftright("__at", 33)
        sizes = sorted((r.part, r.n, r.d) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("deleted", F.lit(False))).alias("d")).collect())  # a row for each part
        total = sum(n for _, n, _ in sizes)
        first = self.last_offset() + 1
        if total:
            starts, at = {}, first
            for p, n, _ in sizes:
                starts[p] = at
                at += n
            begin = F.create_map(*(F.lit(x) for p in starts for x in (p, starts[p])))[part]
            offset = begin + F.col("__at").bitwiseAND((1 << 33) - 1)
            self.write(held.withColumn("offset", offset.cast("long")).withColumn("deleted", F.coalesce("deleted", F.lit(False))).select(*NAMES), f"log/{first:018d}-{total}-{sum(d for *_, d in sizes)}-{uuid.uuid4().hex[:8]}")
        self._fs.delete(self._new(staged), True)
        return first, total

    # reading

    def _read(self, whole: str | None, upto: int, since: int = 0) -> DataFrame:
        """A snapshot and the events above ``upto``; nothing at or below ``since``."""
        paths = ([whole] if whole and since < upto else []) + [f"{self.path}/log/{c.name}" for c in self.commits(max(upto, since))]
        out = self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)
        return out.where(F.col("offset") > since) if since else out

    def log(self, since: int = 0) -> DataFrame:
        """All events there are above ``since``; commits at or below it are not read at all."""
        m = self.manifest()
        return self._read(m["base"], m["base_offset"], since)

    def state(self, store: str, collection: str | None = None, keys: Iterable[str] | None = None, prefix: str | None = None) -> DataFrame:
        """The latest live event of each (collection, key): the newest snapshot and the events after it, folded.

        What is asked for is cut out below the fold, so that it reaches the scan.
        """
        m = self.manifest()
        rows = self._read(m["snapshot"], m["snapshot_offset"]).where(F.col("store") == store)
        if collection is not None:
            rows = rows.where(F.col("collection") == collection)
        if keys is not None:
            rows = rows.where(F.col("key").isin(list(keys)))
        if prefix:
            rows = rows.where(F.col("key").startswith(prefix))
        return changelog.latest(rows, ["collection", "key"], "offset", tombstone=F.col("deleted"))

    def changed(self, store: str, collection: str, since: int) -> DataFrame:
        """(key, latest event's columns, deleted or not) of the keys that changed after ``since``."""
        rows = self.log(since).where((F.col("store") == store) & (F.col("collection") == collection))
        return changelog.latest(rows, ["collection", "key"], "offset")

    def candidates(self, store: str, collection: str, wanted: Mapping[str, str]) -> DataFrame | None:
        """Ids that may match string values of fields: those that the snapshot's postings have, and all that changed since;
        None without a snapshot."""
        from ..operators import postings

        m = self.manifest()
        if not m["snapshot"]:
            return None
        index = self.spark.read.schema(POSTINGS).parquet(f"{m['snapshot']}.postings").where((F.col("store") == store) & (F.col("collection") == collection))
        return postings.candidates(index, dict(wanted)).union(self.changed(store, collection, m["snapshot_offset"]).select("key")).distinct()

    # maintenance

    def snapshot(self) -> int:
        """Write the folded state; the offset that it holds everything up to."""
        m, last = self.manifest(), self.last_offset()
        if m["snapshot"] and last == m["snapshot_offset"]:
            return last
        rows = self._read(m["snapshot"], m["snapshot_offset"]).where(F.col("offset") <= last)
        # what was deleted since an index was built is still told to it; the rest of the deleted keys goes
        oldest = min((x["offset"] for x in m["indexes"].values()), default=last)
        live = changelog.latest(rows, ["store", "collection", "key"], "offset").where(~F.col("deleted") | (F.col("offset") > oldest))
        name = f"state/{last:018d}-{uuid.uuid4().hex[:8]}"
        order = ("store", "collection", "key")
        self.write(live.repartitionByRange(*order).sortWithinPartitions(*order), name)
        held = self.spark.read.schema(LOG).parquet(f"{self.path}/{name}").where(F.col("store").isin(*INDEXED) & ~F.col("deleted"))
        fields = jsons.string_fields(held.withColumnRenamed("key", "id").withColumnRenamed("value", "doc"), "doc", "store", "collection", "id")
        fields = fields.select("store", "collection", F.col("key").alias("field"), "value", "id")
        by = ("store", "collection", "field", "value")
        self.write(fields.repartitionByRange(*by, "id").sortWithinPartitions(*by), f"{name}.postings")
        self.switch(snapshot=f"{self.path}/{name}", snapshot_offset=last, high=last)
        return last

    def compact(self) -> int:
        """From now on the log is the newest snapshot and what follows it; the number of events dropped.  Offsets go on from
        where they were."""
        before = self.log().count()
        last = self.snapshot()
        m = self.manifest()
        self.switch(base=m["snapshot"], base_offset=last, high=last)
        return before - self.log().count()

    def vacuum(self, keep: int = 0) -> int:
        """Remove what no version needs: commits below the base but the newest ``keep`` of the log, older snapshots, manifests and
        what died before its rename; the number of commits that went."""
        m = self.manifest()
        every = self.commits()
        old = [c for c in every[: max(len(every) - keep, 0)] if c.last <= m["base_offset"]]
        for c in old:
            self._fs.delete(self._new(f"{self.path}/log/{c.name}"), True)
        needed = {str(m[k]).rsplit("/", 1)[-1] for k in ("base", "snapshot")}
        for name in self._names("state"):
            if name.removesuffix(".postings") not in needed:
                self._fs.delete(self._new(f"{self.path}/state/{name}"), True)
        for name in self._names("versions")[:-1]:
            self._fs.delete(self._new(f"{self.path}/versions/{name}"), True)
        self._fs.delete(self._new(f"{self.path}/staging"), True)
        return len(old)
