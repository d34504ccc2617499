"""Run files: the binary form in which a collection's records are exchanged, read and written.

A run is a row of records.  A record has a header of 16 bytes (magic, version, flags, length and crc32 of the payload, all
little-endian) and a payload: offset, operation, id, and, where they are there, the vector, the metadata as JSON and the int8
codes with their scale.  Files of the older form have the payload's length alone before each payload.

What a run holds ends at the first record that is cut short, has another magic or version, or whose checksum or payload is
wrong; what comes before counts.  A record whose header and payload name different operations is passed over.  A file is
read by one task, so writers bound it (`TARGET`); Spark's reader takes files of up to 2 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import changelog

# fixed values: the format
MAGIC = 0x524B5631
VERSION = 1
HEADER = struct.Struct("<IHHII")
UPSERT, DELETE = 0, 1

#: A run's size that writers aim at, in bytes.
TARGET = 64 << 20
RECORD = "run string, place long, offset long, deleted boolean, id string, vector array<float>, meta string, scale float, codes array<tinyint>"


def payload(record: Mapping) -> bytes:
    """offset, deleted, id and, or None, vector, meta (a text), and codes with scale."""
    id_ = record["id"].encode()
    out = [struct.pack("<QIQ", record["offset"], DELETE if record["deleted"] else UPSERT, len(id_)), id_]

    def optional(there: bool, *parts: bytes) -> None:
        out.append(b"\1" if there else b"\0")
        out.extend(parts if there else ())

    def counted(items, kind: str) -> bytes:
        numbers = np.asarray(items, kind)
        return struct.pack("<Q", len(numbers)) + numbers.tobytes()

    vector, meta, codes = record.get("vector"), record.get("meta"), record.get("codes")
    optional(vector is not None, b"" if vector is None else counted(vector, "<f4"))
    text = b"" if meta is None else meta.encode()
    optional(meta is not None, struct.pack("<Q", len(text)), text)
    optional(codes is not None, b"" if codes is None else struct.pack("<f", record["scale"]) + counted(codes, "i1"))
    return b"".join(out)


def framed(record: Mapping) -> bytes:
    body = payload(record)
    return HEADER.pack(MAGIC, VERSION, DELETE if record["deleted"] else UPSERT, len(body), zlib.crc32(body)) + body


def parsed(body: bytes) -> dict | None:
    """The record of a payload; None if it isn't one.  Bytes after the record are passed over."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n > len(body) - at:
            raise ValueError("cut short")
        at += n
        return body[at - n : at]

    def number(form: str):
        return struct.unpack(form, take(struct.calcsize(form)))[0]

    def there() -> bool:
        tag = take(1)[0]
        if tag > 1:
            raise ValueError("neither there nor absent")
        return tag == 1

    try:
        offset, op = number("<Q"), number("<I")
        if op not in (UPSERT, DELETE):
            return None
        out = {"offset": offset, "deleted": op == DELETE, "id": take(number("<Q")).decode(), "vector": None, "meta": None, "scale": None, "codes": None}
        if there():
            out["vector"] = np.frombuffer(take(4 * number("<Q")), "<f4")
        if there():
            out["meta"] = take(number("<Q")).decode(errors="replace")
        # the oldest records end before the codes
        if at < len(body) and there():
            out["scale"] = number("<f")
            out["codes"] = np.frombuffer(take(number("<Q")), "i1")
        return out
    except ValueError:
        return None


def records(data: bytes, legacy: bool = False) -> Iterator[dict]:
    """The records of a file, up to the first that is broken."""
    at, n = 0, 4 if legacy else HEADER.size
    while at + n <= len(data):
        if legacy:
            size, flags = struct.unpack_from("<I", data, at)[0], None
        else:
            magic, version, flags, size, check = HEADER.unpack_from(data, at)
            if magic != MAGIC or version != VERSION:
                return
        body = data[at + n : at + n + size]
        if len(body) < size or (flags is not None and zlib.crc32(body) != check):
            return
        record = parsed(body)
        if record is None:
            return
        if flags is None or bool(flags & DELETE) == record["deleted"]:
            yield record
        at += n + size


def read(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """The records (RECORD) of a run file or of all files of a folder; place counts them in their run from 0."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    types = pa.schema([("run", pa.string()), ("place", pa.int64()), ("offset", pa.int64()), ("deleted", pa.bool_()), ("id", pa.string()), ("vector", pa.list_(pa.float32())), ("meta", pa.string()), ("scale", pa.float32()), ("codes", pa.list_(pa.int8()))])

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for place, record in enumerate(records(data.as_py(), legacy)):
                    rows.append(record | {"run": name.rsplit("/", 1)[-1], "place": place})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    return files.mapInArrow(parse, RECORD)


def state(found: DataFrame, dim: int) -> DataFrame:
    """(id, vector, meta, scale, codes, offset): the live items of ``read``'s records, the later record of an id counting, by
    run and place.  Upserts of another dimension change nothing; codes that aren't there are computed; no metadata is null."""
    sound = found.where("deleted").unionByName(found.where(~F.col("deleted") & (F.coalesce(F.size("vector"), F.lit(0)) == dim)))
    last = changelog.latest(sound, ["id"], F.struct(F.length("run"), "run", "place"), tombstone=F.col("deleted"))
    vector = F.col("vector")
    codes = F.coalesce("codes", V.q8_codes(vector, V.q8_scale(vector)))
    return last.select("id", "vector", F.coalesce("meta", F.lit("null")).alias("meta"), F.coalesce(F.col("scale").cast("double"), V.q8_scale(vector)).alias("scale"), codes.alias("codes"), "offset")


def write(rows: DataFrame, path: str, target: int = TARGET) -> DataFrame:
    """``rows`` (offset, deleted, id, vector, meta, scale, codes) as run files of about ``target`` bytes below ``path``, a folder that all
    machines reach, in the order of offsets; (run, records, deletions, bytes) of each, once they are written.

    A range of offsets makes a run.  A run becomes visible by one rename, and a task that is tried again replaces it.
    """
    size = F.lit(HEADER.size + 23) + F.octet_length("id") + 5 * F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)) + F.coalesce(F.octet_length("meta"), F.lit(0))
    total = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    dealt = rows.select("offset", "deleted", "id", "vector", "meta", "scale", "codes").repartitionByRange(-(-total // target) or 1, "offset").sortWithinPartitions("offset")
    types = pa.schema([("run", pa.string()), ("records", pa.int64()), ("deletions", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        import pyarrow.fs

        context = TaskContext.get()
        name, staged = f"run-{context.partitionId() + 1:06d}.log", f".staged-{context.taskAttemptId()}"
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root)
        n = deletions = size = 0
        with fs.open_output_stream(f"{root}/{staged}") as out:
            for batch in batches:
                for record in batch.to_pylist():
                    data = framed(record)
                    out.write(data)
                    n, deletions, size = n + 1, deletions + record["deleted"], size + len(data)
        if n:
            fs.move(f"{root}/{staged}", f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"run": name, "records": n, "deletions": deletions, "bytes": size}], types)
        else:
            fs.delete_file(f"{root}/{staged}")

    # a row for each run
    done = dealt.mapInArrow(run, "run string, records long, deletions long, bytes long").collect()
    return rows.sparkSession.createDataFrame(done, "run string, records long, deletions long, bytes long").orderBy("run")
