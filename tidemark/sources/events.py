"""Event logs: JSON lines (offset, ts_ms, type, data), read whole, from an offset, or as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "offset long, ts_ms long, type string, data string"
TYPES = ("state_updated", "state_deleted", "vector_collection_created", "vector_added", "vector_upserted", "vector_updated", "vector_deleted")


def read(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """Events with an offset above ``since``; lines that are blank or torn are passed over."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where(F.col("offset") > since)


def stream(spark: SparkSession, path: str, since: int = 0, files: int = 1000) -> DataFrame:
    """The same as a stream: what is there, then new files."""
    raw = spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(path)
    return raw.where(F.col("offset") > since)


def filtered(log: DataFrame, types: str | Sequence[str] | None = None, key_prefix: str | None = None, collection: str | None = None, prefix: str | None = None) -> DataFrame:
    """Events of the types (a list, or names between commas; an empty text matches nothing), whose data's key begins with
    ``key_prefix`` (``prefix`` is its old name), whose data's collection equals.  Works on streams too."""
    out = log
    if types is not None:
        wanted = [t.strip() for t in types.split(",")] if isinstance(types, str) else list(types)
        out = out.where(F.col("type").isin([t for t in wanted if t]))
    begin = key_prefix if key_prefix is not None else prefix
    if begin is not None:
        out = out.where(F.get_json_object("data", "$.key").startswith(begin))
    if collection is not None:
        out = out.where(F.get_json_object("data", "$.collection") == collection)
    return out


def ring(log: DataFrame, capacity: int, since: int = 0) -> DataFrame:
    """What a bounded buffer of the newest ``capacity`` events still holds after ``since``; a reader that is further behind has
    a gap."""
    return log.orderBy(F.desc("offset")).limit(max(capacity, 16)).where(F.col("offset") > since)


#: What is sent every 15 seconds (a fixed value) while there are no events.
KEEP_ALIVE = ": keepalive\n\n"


def frames(log: DataFrame) -> DataFrame:
    """(offset, frame): each event (SCHEMA) as a server-sent event, named by its type, with its offset as id and the event as
    JSON on one line of data.  Data that isn't JSON is null there.  Works on streams too."""
    data = F.coalesce(F.to_json(F.try_parse_json("data")), F.lit("null"))
    head = F.to_json(F.struct("offset", "ts_ms", "type"), {"ignoreNullFields": "false"})
    # the head without its closing brace, then the data as it is
    event = F.concat(F.expr("substring(__head, 1, length(__head) - 1)"), F.lit(',"data":'), data, F.lit("}"))
    name = F.translate("type", "\r\n", "  ")
    return log.withColumn("__head", head).select("offset", F.concat(F.lit("event: "), name, F.lit("\nid: "), F.col("offset"), F.lit("\ndata: "), event, F.lit("\n\n")).alias("frame"))


def append(log: DataFrame, path: str) -> None:
    """Add events (SCHEMA) as JSON lines."""
    log.select("offset", "ts_ms", "type", "data").write.mode("append").json(path)


def state_changes(log: DataFrame) -> DataFrame:
    """(key, value, deleted, expires_at_ms, offset) of the state events; others have no effect on the state."""
    field = lambda f: F.get_json_object("data", f"$.{f}")
    own = log.where(F.col("type").isin("state_updated", "state_deleted"))
    return own.select(field("key").alias("key"), field("value").alias("value"), (F.col("type") == "state_deleted").alias("deleted"), field("expires_at_ms").cast("long").alias("expires_at_ms"), "offset")
