"""Run files, API keys and event frames."""

import json
import struct
import zlib

import numpy as np
import pytest

from tidemark.engine import Engine
from tidemark.errors import EngineError
from tidemark.sources import events as E
from tidemark.sources import runfiles


def record(offset, id, vector=None, meta=None, deleted=False):
    return {"offset": offset, "id": id, "vector": vector, "meta": meta, "deleted": deleted}


def test_a_record_byte_by_byte():
    body = struct.pack("<QIQ", 7, 0, 1) + b"a" + b"\1" + struct.pack("<Qff", 2, 1.0, -2.5) + b"\1" + struct.pack("<Q", 4) + b"null" + b"\1" + struct.pack("<fQ", 0.5, 2) + bytes([1, 254])
    whole = record(7, "a", [1.0, -2.5], "null") | {"scale": 0.5, "codes": [1, -2]}
    assert runfiles.payload(whole) == body
    assert runfiles.framed(whole) == struct.pack("<IHHII", 0x524B5631, 1, 0, len(body), zlib.crc32(body)) + body
    back = runfiles.parsed(body)
    assert (back["id"], list(back["vector"]), back["meta"], back["scale"], list(back["codes"])) == ("a", [1.0, -2.5], "null", 0.5, [1, -2])
    # no prefix of a record is one, but that which ends before the codes
    ends = [i for i in range(len(body)) if runfiles.parsed(body[:i]) is not None]
    assert ends == [len(body) - 1 - 4 - 8 - 2]


def test_records_end_at_the_first_broken_one():
    parts = [runfiles.framed(record(i, f"é{i}", [float(i)], "{}")) for i in range(1, 4)]
    ids = lambda data: [r["id"] for r in runfiles.records(data)]
    assert ids(b"".join(parts)) == ["é1", "é2", "é3"] and ids(b"") == []
    for cut in range(1, len(parts[2])):
        assert ids(parts[0] + parts[1] + parts[2][:-cut]) == ["é1", "é2"]
    for at in (0, 4, 12, 16, len(parts[1]) - 1):  # magic, version, checksum, payload
        broken = bytearray(parts[1])
        broken[at] ^= 1
        assert ids(parts[0] + bytes(broken) + parts[2]) == ["é1"]
    other = bytearray(parts[1])
    other[6] ^= 1  # the header says delete, the payload upsert
    assert ids(parts[0] + bytes(other) + parts[2]) == ["é1", "é3"]


def test_runs_are_written_in_order_and_folded(spark, tmp_path):
    schema = "offset long, deleted boolean, id string, vector array<float>, meta string, scale float, codes array<tinyint>"
    rows = [(i, i % 10 == 9, f"i{i % 50}", None if i % 10 == 9 else [float(i), 1.0], None, None, None) for i in range(1, 401)]
    path = f"file://{tmp_path}/runs"
    done = runfiles.write(spark.createDataFrame(rows, schema), path, 2000).collect()
    assert len(done) > 3 and [r.run for r in done] == sorted(r.run for r in done)
    assert sum(r.records for r in done) == 400 and sum(r.deletions for r in done) == 40
    assert {r.run: r.bytes for r in done} == {f.name: f.stat().st_size for f in (tmp_path / "runs").iterdir() if f.suffix == ".log"}
    back = runfiles.read(spark, path).orderBy("run", "place").collect()
    assert [r.offset for r in back] == list(range(1, 401))
    wanted = {}
    for offset, deleted, id, vector, *_ in rows:
        wanted.pop(id, None) if deleted else wanted.update({id: vector})
    got = {r.id: r for r in runfiles.state(runfiles.read(spark, path), 2).collect()}
    assert {k: list(r.vector) for k, r in got.items()} == wanted and all(r.meta == "null" and len(r.codes) == 2 for r in got.values())
    assert runfiles.state(runfiles.read(spark, path), 3).isEmpty()
    assert runfiles.write(spark.createDataFrame([], schema), f"file://{tmp_path}/none").isEmpty()


def test_collections_travel_as_runs(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/a")
    engine.vector.create_collection("c", 3)
    engine.vector.upsert_batch("c", [{"id": f"v{i}", "vector": [i, 1, 0], "meta": {"n": i}} for i in range(30)])
    engine.vector.delete("c", "v7")
    assert engine.vector.export_runs("c", f"file://{tmp_path}/runs", 1000).agg({"records": "sum"}).first()[0] == 29
    engine.vector.create_collection("d", 3)
    assert {r.status for r in engine.vector.import_runs("d", f"file://{tmp_path}/runs").collect()} == {"ok"}
    assert engine.vector.get("d", "v8") == engine.vector.get("c", "v8") and engine.vector.get("d", "v7") is None
    # the older form: a length before each payload, no codes
    (tmp_path / "old").mkdir()
    bodies = [runfiles.payload(record(i, f"o{i}", np.array([i, 0, 1], "f4"), '{"old":true}'))[:-1] for i in range(1, 4)]
    (tmp_path / "old" / "vectors.bin").write_bytes(b"".join(struct.pack("<I", len(b)) + b for b in bodies) + b"\x09\0\0\0abc")
    engine.vector.import_runs("d", f"file://{tmp_path}/old", legacy=True)
    assert engine.vector.get("d", "o3")["vector"] == [3, 0, 1] and engine.vector.get("d", "o3")["meta"] == {"old": True}


def test_keys(spark, tmp_path):
    keys = Engine(spark, f"file://{tmp_path}").keys
    assert keys.list().isEmpty() and keys.validate("x") is None and not keys.revoke("x")
    first = keys.bootstrap()
    assert first.startswith("tm_live_") and len(first) == 8 + 43 and keys.bootstrap() is None
    assert keys.validate(first)["role"] == "admin" and keys.validate(first)["permissions"] == {"allow": "*"}
    id_ = keys.create("reader", "user", "secret", {"allow": ["state"]}, at=1)
    with pytest.raises(EngineError) as e:
        keys.create("again", "user", "secret", {})
    assert e.value.code == "already_exists"
    keys.ensure("secret")
    keys.ensure("dev")
    listed = keys.list().collect()
    assert len(listed) == 3 and listed[-1].id == id_ and "key_hash" not in listed[0].asDict()
    asked = spark.createDataFrame([("secret", 1), ("unknown", 2), ("dev", 3)], "key string, n int")
    assert sorted((r.n, r.role) for r in keys.validate_frame(asked).collect()) == [(1, "user"), (3, "admin")]
    assert keys.revoke(id_) and keys.validate("secret") is None and not keys.revoke(id_)
    assert not any("secret" in f.read_text(errors="replace") for f in tmp_path.rglob("*.parquet"))


def test_frames(spark, tmp_path):
    log = spark.createDataFrame([(3, 9, "state_updated", '{"key":"a\\nb","value":{"x":1}}'), (4, 9, "odd\nname", "no json"), (5, 9, "none", None)], E.SCHEMA)
    frames = {r.offset: r.frame for r in E.frames(log).collect()}
    lines = frames[3].split("\n")
    assert lines[:2] == ["event: state_updated", "id: 3"] and lines[3:] == ["", ""]
    assert json.loads(lines[2].removeprefix("data: ")) == {"offset": 3, "ts_ms": 9, "type": "state_updated", "data": {"key": "a\nb", "value": {"x": 1}}}
    assert frames[4].startswith("event: odd name\nid: 4\ndata: ") and '"data":null}' in frames[4] and '"data":null}' in frames[5]
    engine = Engine(spark, f"file://{tmp_path}")
    engine.state.put("k", 1)
    engine.state.put("m", 2)
    assert [r.offset for r in engine.events.frames(since=1).collect()] == [2]
