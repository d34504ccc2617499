"""Streams over event logs: gaps, expiry, and folds into tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import changelog
from ..session import ship
from ..sources import events

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Gap(StatefulProcessor):
    """Keeps the last offset of a log; a hole becomes a row (log, from_offset, to_offset, dropped)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "offset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        offsets = sorted(int(o) for frame in rows for o in frame["offset"])
        last = self.last.get()[0] if self.last.exists() else None
        found = []
        for o in offsets:
            if last is not None and o > last + 1:
                found.append((key[0], last + 1, o - 1, o - last - 1))
            last = o if last is None else max(last, o)
        if last is not None:
            self.last.update((last,))
        if found:
            yield pd.DataFrame(found, columns=["log", "from_offset", "to_offset", "dropped"])

    def close(self) -> None:
        pass


def gaps(stream: DataFrame, log: str = "log") -> DataFrame:
    """Holes in the offsets of each ``log`` as they pass by, across batches.  Needs ROCKS as state store."""
    ship(stream.sparkSession)
    return stream.select(log, "offset").groupBy(log).transformWithStateInPandas(_Gap(), "log string, from_offset long, to_offset long, dropped long", "Append", "None")


class _Expiry(StatefulProcessor):
    """Keeps the expiry of a key and emits its deletion when the time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values("offset")
        last = changes.iloc[-1]
        if self.expires.exists():
            self.handle.deleteTimer(self.expires.get()[0])
            self.expires.clear()
        if not last["deleted"] and not pd.isna(last["expires_at_ms"]):
            at = int(last["expires_at_ms"])
            self.expires.update((at,))
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.expires.clear()
        yield pd.DataFrame({"key": [key[0]], "type": ["state_deleted"], "reason": ["ttl"], "expired_at_ms": [at]})

    def close(self) -> None:
        pass


def expired(changes: DataFrame) -> DataFrame:
    """A ``state_deleted`` event with reason ``ttl`` for each key whose time has come.  ``changes`` is a stream of
    `sources.events.state_changes`; a later put without expiry, or a delete, takes the timer back.  Needs ROCKS."""
    ship(changes.sparkSession)
    return changes.groupBy("key").transformWithStateInPandas(_Expiry(), "key string, type string, reason string, expired_at_ms long", "Append", "ProcessingTime")


def windowed(stream: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts by event-time window, with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def fold(spark: SparkSession, log: str, target: str, checkpoint: str, since: int = 0) -> DataFrame:
    """Catch up: fold the event log into a key-value table below ``target`` and return the state.

    Each micro-batch appends its changes to ``target`` in a folder named by the batch, so a batch that is run again replaces
    what it wrote; offsets make the fold independent of the order.  The state is the latest change of each key.
    """
    changes = events.state_changes(events.stream(spark, log, since))

    def write(batch: DataFrame, number: int) -> None:
        newest = changelog.latest(batch, ["key"], "offset")
        newest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = "key string, value string, deleted boolean, expires_at_ms long, offset long, batch long"
    return changelog.latest(spark.read.schema(schema).parquet(target).drop("batch"), ["key"], "offset", tombstone=F.col("deleted"))
