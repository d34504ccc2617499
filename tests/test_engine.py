import json

import pytest

from tidemark.config import IndexSettings
from tidemark.engine import Engine
from tidemark.errors import EngineError


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def code(f, *args, **kw):
    with pytest.raises(EngineError) as e:
        f(*args, **kw)
    return e.value.code


def test_revisions_and_compare_and_set(engine):
    assert engine.state.put("k", {"a": 1})["revision"] == 1
    assert engine.state.put("k", {"a": 2}, if_revision=1)["revision"] == 2
    assert code(engine.state.put, "k", {"a": 3}, if_revision=1) == "revision_mismatch"
    assert engine.state.get("k")["value"] == {"a": 2}
    assert engine.state.delete("k") and engine.state.get("k") is None and not engine.state.delete("k")
    # a deleted key begins anew
    assert engine.state.put("k", 1)["revision"] == 1
    assert code(engine.state.put, "new", 1, if_revision=1) == "revision_mismatch"


def test_expiry(engine):
    engine.state.put("t", 1, ttl_ms=100, at=1000)
    assert engine.state.get("t", at=1099) and engine.state.get("t", at=1100) is None
    engine.state.put("t", 2, at=1050)  # no ttl: the old one is gone
    assert engine.state.get("t", at=99999)["revision"] == 2
    engine.state.put("u", 1, ttl_ms=50, at=1000)
    assert engine.state.expire(at=2000) == ["u"]
    last = engine.events.read(types="state_deleted").collect()[-1]
    assert (last.key, last.reason) == ("u", "ttl")


def test_batch_put_reports_each_operation(engine):
    done = engine.state.batch_put([{"key": "a", "value": 1}, {"key": "a", "value": 2, "if_revision": 1}, {"key": "b", "value": "x" * 70000}, {"key": "c", "value": 1, "if_revision": 9}, {"key": "", "value": 1}])
    assert [r.get("error", "ok") for r in done] == ["ok", "ok", "payload_too_large", "revision_mismatch", "invalid_argument"]
    assert [r.key for r in engine.state.list("a").collect()] == ["a"]
    assert engine.state.get("a")["revision"] == 2


def test_vectors(engine):
    v = engine.vector
    v.create_collection("c", 4)
    assert code(v.create_collection, "c", 4) == "already_exists" and code(v.info, "none") == "not_found"
    v.add("c", "vec1", [1, 0, 0, 0], {"tag": "A"})
    assert code(v.add, "c", "vec1", [1, 0, 0, 0]) == "already_exists"
    hit = v.search("c", [1, 0, 0, 0], 1).first()
    assert hit.id == "vec1" and abs(hit.score - 1) < 1e-4 and json.loads(hit.meta) == {"tag": "A"}
    assert code(v.search, "c", [1, 0], 1) == "dim_mismatch" and code(v.search, "c", [1, 0, 0, 0], 0) == "invalid_argument"
    v.update("c", "vec1", vector=[0, 1, 0, 0])
    assert v.get("c", "vec1")["meta"] == {"tag": "A"} and v.get("c", "vec1")["vector"] == [0, 1, 0, 0]
    done = v.upsert_batch("c", [{"id": "x", "vector": [1, 1, 0, 0]}, {"id": "y", "vector": [1]}])
    assert [r["status"] for r in done] == ["ok", "error"] and done[1]["error"] == "dim_mismatch"
    v.delete("c", "vec1")
    assert code(v.delete, "c", "vec1") == "not_found"
    info = v.info("c")
    assert info["live"] == 1 and info["records"] == 4 and info["dim"] == 4


def test_dot_is_normalised_and_filters_come_first(engine):
    v = engine.vector
    v.create_collection("d", 2, "dot")
    v.upsert_batch("d", [{"id": "a", "vector": [3, 4], "meta": {"n": 1}}, {"id": "b", "vector": [0, 0], "meta": {"n": 1.0}}, {"id": "z", "vector": [1, 0], "meta": {"n": "1"}}])
    assert [round(x, 6) for x in v.get("d", "a")["vector"]] == [0.6, 0.8]
    assert [(r.id, round(r.score, 6)) for r in v.search("d", [6, 8], 10).collect()] == [("a", 1.0), ("z", 0.6), ("b", 0.0)]
    assert [r.id for r in v.search("d", [1, 0], 1, {"n": 1}).collect()] == ["a"]
    assert [r.id for r in v.search("d", [1, 0], 1, {"n": "1"}).collect()] == ["z"]


def test_graph_is_dropped_by_changes(engine):
    v = engine.vector
    v.create_collection("g", 3)
    v.upsert_batch("g", [{"id": "north", "vector": [1, 0, 0]}, {"id": "east", "vector": [0, 1, 0]}, {"id": "west", "vector": [0, -1, 0]}])
    assert v.build_graph("g", 16, 48) == {"available": True, "degree": 16, "search_list": 48}
    assert v.tune_graph("g", 96)["search_list"] == 96
    assert v.graph_search("g", [1, 0, 0], 1).first().id == "north"
    v.upsert("g", "up", [1, 0.01, 0])
    assert not v.graph_status("g")["available"]
    assert [r.id for r in v.graph_search("g", [1, 0, 0], 2).collect()] == ["north", "up"]


def test_documents(engine):
    engine.doc.put("users", "u1", {"name": "Ada", "role": "admin", "n": 1})
    engine.doc.put("users", "u2", {"name": "Bob", "role": "user"})
    assert engine.doc.put("users", "u1", {"name": "Ada", "role": "admin", "n": 2})["revision"] == 2
    assert [r.id for r in engine.doc.find("users", {"role": "admin"}).collect()] == ["u1"]
    assert engine.doc.find("users", {"n": "2"}).isEmpty() and not engine.doc.find("users", {"n": 2}).isEmpty()
    assert engine.doc.find("other", {"role": "admin"}).isEmpty()
    assert engine.doc.delete("users", "u1") and engine.doc.get("users", "u1") is None


def test_sql_tables(engine):
    sql = engine.sql
    sql.create("users", "id long, name string, age int")
    assert sql.insert("users", engine.spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 31)], "id long, name string, age int")) == 2
    assert sql.query("SELECT name, age FROM users WHERE name = ?", ["Alice"]).collect()[0].age == 30
    assert sql.update("users", {"age": 40}, {"id": 2}) == 1 and sql.delete("users", {"id": 1}) == 1
    assert [tuple(r) for r in sql.query("SELECT * FROM users").collect()] == [(2, "Bob", 40)]
    assert code(sql.query, "DELETE FROM users") == "invalid_argument" and code(sql.query, "SELECT * FROM nowhere") == "sql_error"
    assert code(sql.query, "SELECT ?", [[1]]) == "invalid_argument" and code(sql.delete, "users", {"id = 1 OR 1": 1}) == "invalid_argument"


def test_hybrid(engine):
    engine.vector.create_collection("v", 4)
    engine.vector.upsert("v", "doc1", [1, 0, 0, 0], {"id": "doc1"})
    engine.sql.create("items", "id string, name string")
    engine.sql.insert("items", engine.spark.createDataFrame([("doc1", "foo"), ("7", "bar")], "id string, name string"))
    rows = engine.meta({"type": "hybrid", "collection": "v", "vector": [1, 0, 0, 0], "k": 10, "sql": "SELECT * FROM items ORDER BY name DESC"}).collect()
    assert [r.id for r in rows] == ["doc1", "7"] and abs(rows[0].rrf_score - 2 / 61) < 1e-12 and json.loads(rows[0].payload)["score"] == 1.0
    assert code(engine.meta, {"type": "other"}) == "invalid_argument"


def test_compaction_keeps_the_state(engine):
    for i in range(3):
        engine.state.put("k", i)
    engine.state.put("gone", 1)
    engine.state.delete("gone")
    assert engine.compact() == 4
    assert engine.state.get("k")["value"] == 2 and engine.state.put("k", 9)["revision"] == 4


CHUNK = "id long, vector array<float>, content string, metadata struct<filename:string, processed_at:bigint, category:string, language:string, status:string, version:string, group_id:bigint, document_id:string>"


def chunks(spark, *rows):
    return spark.createDataFrame([(i, v, f"text {i}", (None, at, None, "en", None, None, g, doc)) for i, v, doc, g, at in rows], CHUNK)


def test_chunks(engine):
    rows = [(0, [0.9, 0.1], "a", None, None), (1, [0.91, 0.09], "a", None, None), (2, [0.8, 0.2], "b", 1, 5), (3, [0.99, 0.01], "b", 1, 4), (4, [1.0, 0.0, 0.0], "c", None, None)]
    engine.rag.ingest(chunks(engine.spark, *rows))
    every = [r.id for r in engine.rag.search("TEST_VEC:1.0,0.0").collect()]
    assert every == [1, 0, 2]
    assert [r.id for r in engine.rag.search("TEST_VEC:1.0,0.0", group_by="document_id").collect()] == [1, 2]
    assert len(engine.rag.search("TEST_VEC:1.0,0.0", group_by="no_such_field").collect()) == 3
    assert engine.rag.search("TEST_VEC:1.0,0.0", language=["fr"]).isEmpty()
    assert code(engine.rag.search, "", 1) == "invalid_argument"


def test_settings_are_clamped():
    s = IndexSettings(kind="other", clusters=1, nprobe=0, refine=0, min_train=0, retrain_min=0, degree=1, search_list=1).clamped()
    assert (s.kind, s.clusters, s.nprobe, s.refine, s.min_train, s.retrain_min, s.degree, s.search_list) == ("exact", 2, 1, 1, 2, 1, 4, 8)


def explained(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_offsets_go_on_after_compaction(engine, spark):
    engine.state.put("a", 1)
    engine.state.put("b", 1)
    engine.state.delete("b")
    assert engine.compact() == 2 and engine.last_offset() == 3
    engine.state.put("c", 1)
    assert [(r.offset, r.key) for r in engine.events.read(since=3).collect()] == [(4, "c")]
    again = Engine(spark, engine.path)
    assert again.last_offset() == 4 and [r.key for r in again.state.list().collect()] == ["a", "c"]
    assert again.retain() == 3 and [(r.offset, r.key) for r in again.events.read().collect()] == [(1, "a"), (4, "c")]
    assert again.state.put("b", 2)["revision"] == 1 and again.last_offset() == 5


def test_reading_starts_from_the_snapshot(engine, spark):
    engine.state.put("k", 1)
    engine.doc.put("u", "1", {"name": "Ada"})
    assert engine.snapshot() == 2 and engine.snapshot() == 2
    engine.state.put("k", 2)
    engine.state.put("new", 1)
    engine.state.delete("new")
    # the commits below the snapshot are gone, as after a loss: state is what the snapshot and the later commits say
    for c in engine.files.commits()[:2]:
        engine.files._fs.delete(engine.files._new(f"{engine.path}/log/{c.name}"), True)
    again = Engine(spark, engine.path)
    assert again.state.get("k")["revision"] == 2 and again.doc.get("u", "1")["doc"] == {"name": "Ada"}
    assert again.state.get("new") is None and again.last_offset() == 5
    # what died before its rename doesn't count
    engine.files._fs.mkdirs(engine.files._new(f"{engine.path}/staging/dead"))
    assert again.state.get("k")["value"] == 2 and again.retain() == 0


def test_point_reads_reach_the_scan(engine):
    engine.state.put("k", 1)
    engine.snapshot()
    engine.state.put("l", 1)
    for frame in (engine.state.table(keys=["k"]), engine.state.table().where("key = 'k'")):
        pushed = next(x for x in explained(frame).splitlines() if x.startswith("PushedFilters"))
        assert "EqualTo(key,k)" in pushed and "EqualTo(store,state)" in pushed


def test_maintenance(spark, tmp_path):
    from tidemark.config import Maintenance

    engine = Engine(spark, f"file://{tmp_path}", maintenance=Maintenance(snapshot_commits=3, deleted_share=0.4, least_events=8))
    for i in range(5):
        engine.state.put(f"k{i}", i)
    assert engine.files.manifest()["snapshot_offset"] == 3 and engine.counters["snapshots"] == 1
    for i in range(4):
        engine.state.delete(f"k{i}")
    stats = engine.stats()
    assert stats["compactions"] == 1 and stats["base_offset"] == 9 and stats["events"] == 0
    assert [r.key for r in engine.state.list().collect()] == ["k4"] and engine.state.get("k4")["revision"] == 1


def test_documents_are_found_through_the_index(engine):
    for i in range(6):
        engine.doc.put("users", f"u{i}", {"role": "admin" if i % 2 else "user", "n": i})
    assert engine.doc.candidates("users", {"role": "admin"}) is None  # no snapshot, no index
    engine.snapshot()
    engine.doc.put("users", "u0", {"role": "admin"})
    engine.doc.put("users", "u1", {"role": "user"})
    engine.doc.delete("users", "u3")
    assert {r.id for r in engine.doc.candidates("users", {"role": "admin"}).collect()} == {"u0", "u1", "u3", "u5"}
    assert [r.id for r in engine.doc.find("users", {"role": "admin"}).collect()] == ["u0", "u5"]
    assert engine.doc.candidates("users", {"n": 1}) is None and [r.id for r in engine.doc.find("users", {"n": 4}).collect()] == ["u4"]


def ring(n, dim=8):
    import math

    return [[math.cos(i * 6.2831 / n + j) + 0.01 * j for j in range(dim)] for i in range(n)]


@pytest.mark.parametrize("copies", [1, 2])
def test_cluster_index(spark, tmp_path, copies):
    settings = IndexSettings(kind="ivf", clusters=8, nprobe=3, refine=40, min_train=50, retrain_min=120, copies=copies)
    engine = Engine(spark, f"file://{tmp_path}")
    v = engine.vector
    v.create_collection("c", 8, index=settings)
    assert v.train("c") is None and v.search("c", [1.0] * 8, 3).isEmpty()
    items = [{"id": f"i{i:03}", "vector": x, "meta": {"part": "odd" if i % 2 else "even"}} for i, x in enumerate(ring(200))]
    v.upsert_batch("c", items[:30])
    assert not v.index_status("c")["available"]
    v.upsert_batch("c", items)
    # enough items: trained on write
    assert v.index_status("c")["available"] and engine.counters["trainings"] == 1
    assert v.train("c").count() == 8 and v.index_status("c")["changed"] == 0
    query = items[17]["vector"]
    exact = [r.id for r in v.search("c", query, 5, kind="exact").collect()]
    found = v.search("c", query, 5)
    pruned = [x for x in explained(found).splitlines() if x.startswith("PartitionFilters")]
    assert [r.id for r in found.collect()] == exact and any("cluster" in x for x in pruned)
    # changes since are seen: a deleted item, a moved one, a new one
    v.delete("c", exact[0])
    v.upsert("c", exact[1], [-x for x in query])
    v.upsert("c", "new", query, {"part": "odd"})
    after = [r.id for r in v.search("c", query, 5).collect()]
    assert after == [r.id for r in v.search("c", query, 5, kind="exact").collect()] and after[0] == "new" and exact[0] not in after
    assert {r.id for r in v.search("c", query, 4, {"part": "odd"}).collect()} == {r.id for r in v.search("c", query, 4, {"part": "odd"}, kind="exact").collect()}
    # compaction keeps telling the index what was deleted; another process finds it
    engine.compact()
    engine.retain()
    again = Engine(spark, engine.path)
    assert [r.id for r in again.vector.search("c", query, 5).collect()] == after and again.vector.settings("c") == settings.clamped()
    # enough changes train anew
    again.vector.upsert_batch("c", [{"id": f"j{i}", "vector": x} for i, x in enumerate(ring(150))])
    assert again.counters["trainings"] == 1 and again.vector.index_status("c")["changed"] == 0
    again.vector.drop_index("c")
    assert not again.vector.index_status("c")["available"]


def test_graph_outlives_the_process(spark, tmp_path, monkeypatch):
    from tidemark.operators import graph

    monkeypatch.setattr(graph, "SUBGRAPH", 16)
    engine = Engine(spark, f"file://{tmp_path}")
    engine.vector.create_collection("g", 8)
    engine.vector.upsert_batch("g", [{"id": f"i{i:03}", "vector": x, "meta": i} for i, x in enumerate(ring(200))])
    engine.vector.build_graph("g", 8, 32)
    again = Engine(spark, engine.path)
    assert again.vector.graph_status("g")["available"]
    found = again.vector.search("g", ring(200)[5], 3, kind="graph").collect()
    assert found[0].id == "i005" and json.loads(found[0].meta) == 5
    again.vector.drop_graph("g")
    assert not Engine(spark, engine.path).vector.graph_status("g")["available"]


def test_frames(engine, spark):
    v = engine.vector
    v.create_collection("f", 2, "dot")
    rows = spark.createDataFrame([(f"k{i}", [float(i), 1.0], json.dumps({"n": i})) for i in range(500)] + [("bad", [1.0], None), ("", [1.0, 1.0], None)], "id string, vector array<double>, meta string").repartition(5)
    done = {r.id: r.status for r in v.upsert_frame("f", rows, fresh=True).collect()}
    assert done["k3"] == "ok" and done["bad"] == "dim_mismatch" and done[""] == "invalid_argument"
    assert engine.last_offset() == 501 and sorted(r.offset for r in engine.events.read(types="vector_added").collect()) == list(range(2, 502))
    assert [round(x, 4) for x in v.get("f", "k1")["vector"]] == [0.7071, 0.7071]
    assert v.upsert_frame("f", rows.where("id = 'k1'"), fresh=True).first().status == "already_exists" and engine.last_offset() == 501
    status = v.update_frame("f", spark.createDataFrame([("k1", None, '{"n":-1}'), ("no", None, None)], "id string, vector array<float>, meta string"))
    assert {r.id: r.status for r in status.collect()} == {"k1": "ok", "no": "not_found"}
    assert v.get("f", "k1")["meta"] == {"n": -1} and round(v.get("f", "k1")["vector"][0], 4) == 0.7071
    assert {r.id: r.status for r in v.delete_frame("f", spark.createDataFrame([("k1",), ("no",)], "id string")).collect()} == {"k1": "ok", "no": "not_found"}
    assert v.info("f")["live"] == 499
    ops = spark.createDataFrame([("a", "1", None), ("b", "2", 7), ("", "3", None), ("c", '"' + "x" * 70000 + '"', None)], "key string, value string, if_revision long")
    assert {r.key: r.status for r in engine.state.put_frame(ops).collect()} == {"a": "created", "b": "revision_mismatch", "": "invalid_argument", "c": "payload_too_large"}
    done = engine.state.put_frame(spark.createDataFrame([("a", "5", 1, 100)], "key string, value string, if_revision long, ttl_ms long"), at=1000).first()
    assert (done.status, done.revision) == ("updated", 2) and engine.state.get("a", at=1099)["value"] == 5 and engine.state.get("a", at=1100) is None


def test_statements(engine):
    sql = engine.sql
    run = lambda text, *values: sql.execute(text, values)["rows_affected"]
    assert run("CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, price REAL, PRIMARY KEY (id))") == 0 == run("CREATE TABLE IF NOT EXISTS t (id INTEGER)")
    assert run("INSERT INTO t (id, name) VALUES (?, ?), (2, 'b; ?')", 1, "it's") == 2
    assert run("INSERT INTO t SELECT id + 10, name, 2.5 FROM t") == 2 and run("INSERT INTO t VALUES (5, NULL, 1)") == 1
    parts = set(sql._version("t")["parts"])
    assert run("UPDATE t SET price = price * ?, name = 'x, y WHERE z' WHERE id > ? AND price IS NOT NULL", 2, 10) == 2
    # the parts without a hit stay
    assert len(parts & set(sql._version("t")["parts"])) == 2
    rows = sql.execute("SELECT id, name, price FROM t ORDER BY id")["rows"].collect()
    assert [tuple(r) for r in rows] == [(1, "it's", None), (2, "b; ?", None), (5, None, 1.0), (11, "x, y WHERE z", 5.0), (12, "x, y WHERE z", 5.0)]
    assert run("DELETE FROM t WHERE name = ? OR id = 5", "it's") == 2 and run("DELETE FROM t WHERE name = 'none'") == 0
    assert run("DELETE FROM t") == 3 and sql.query("SELECT count(*) AS n FROM t").first().n == 0
    run("DROP TABLE t")
    assert code(sql.execute, "DROP TABLE t") == "not_found" and run("DROP TABLE IF EXISTS t") == 0
    for bad in ("BEGIN", "CREATE TRIGGER x", "SELECT ?", "PRAGMA x"):
        assert code(sql.execute, bad) == "sql_error"


def test_dialect_in_queries(engine):
    sql = engine.sql
    sql.execute("CREATE TABLE n (a INT, b INT, s TEXT)")
    sql.execute("INSERT INTO n VALUES (7, 2, 'Ab'), (-7, 2, 'ab'), (7, 0, NULL)")
    rows = sql.query("SELECT a / b AS q, a % b AS r, a * 2 / b AS p, a / 2.0 AS f, s LIKE 'AB' AS l, s IS NULL AS z, max(a, b) AS m, iif(b > 0, 'y', 'n') AS i FROM n ORDER BY b DESC, a DESC").collect()
    assert [tuple(r) for r in rows] == [(3, 1, 7, 3.5, True, False, 7, "y"), (-3, -1, -7, -3.5, True, False, 2, "y"), (None, None, None, 3.5, None, True, 7, "n")]
    one = sql.query("SELECT total(a) AS t, total(a) / count(*) AS mean, group_concat(s) AS g, json_group_array(b) AS j, json_group_object(s, b) AS o FROM n WHERE b IS 2").first()
    assert one.t == 0.0 and one.mean == 0.0 and sorted(one.g.split(",")) == ["Ab", "ab"] and json.loads(one.j) == [2, 2] and json.loads(one.o) == {"Ab": 2, "ab": 2}
    assert sql.query("SELECT 'a/b' AS s -- a / b\n FROM n WHERE s = 'a/b'").isEmpty()


def test_parts_have_one_face(engine):
    from tidemark.adapters import parts

    found = parts(engine)
    engine.vector.create_collection("v", 2)
    found["vector"].add("v", "a", {"vector": [1, 0], "meta": {"t": "x"}})
    assert found["vector"].search("v", {"vector": [1, 0], "filters": {"t": "x"}}).first().id == "a"
    engine.sql.execute("CREATE TABLE t (id TEXT, n INT)")
    found["sql"].add("t", "1", {"id": "1", "n": 5})
    assert found["sql"].search("t", {"n": 5}).first().id == "1" and found["sql"].search("t", {"sql": "WITH x AS (SELECT n FROM t) SELECT * FROM x"}).first().n == 5
    found["doc"].add("d", "1", {"a": "b"})
    assert found["doc"].search("d", {"filter": {"a": "b"}}).first().id == "1" and found["doc"].stats() == {"d": 1}
    assert found["sql"].stats() == {"t": 1} and found["vector"].stats()["collections"] == 1
    assert found["vector"].delete("v", "a") and not found["vector"].delete("v", "a")
    assert found["sql"].delete("t", "1") and not found["sql"].delete("t", "1") and found["doc"].delete("d", "1")
    assert all(p.health()["status"] == "ok" for p in found.values())


def test_command_line(engine, monkeypatch, capsys):
    import tidemark.session
    from tidemark.__main__ import arguments, main

    monkeypatch.setenv("TIDEMARK_MAX_K", "7")
    assert arguments(["p", "stats"])[1].max_k == 7 and arguments(["p", "stats", "--max-k", "9"])[1].max_k == 9
    engine.state.put("a", 1)
    engine.state.put("a", 2)
    monkeypatch.setattr(tidemark.session, "session", lambda master=None: engine.spark)
    assert main([engine.path, "snapshot"]) == {"snapshot_offset": 2}
    assert main([engine.path, "vacuum"]) == {"dropped": 1, "removed": 2} and main([engine.path, "stats"])["last_offset"] == 2
    assert json.loads(capsys.readouterr().out.splitlines()[0]) == {"snapshot_offset": 2}


def test_hashes_and_base64(spark):
    import base64
    import zlib

    from pyspark.sql import functions as F

    from tidemark.functions import jsons

    values = [b"", b"a", bytes(range(250, 256)) * 3, bytes(range(256)) * 4]
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i long, b binary").select("i", F.crc32("b").alias("c"), jsons.base64_plain(F.col("b")).alias("p"), jsons.base64_plain(F.col("b"), True).alias("u"))
    assert [(r.c, r.p, r.u) for r in rows.orderBy("i").collect()] == [(zlib.crc32(v), base64.b64encode(v).decode().rstrip("="), base64.urlsafe_b64encode(v).decode().rstrip("=")) for v in values]
