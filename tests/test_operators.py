import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import IndexSettings
from tidemark.functions import jsons
from tidemark.functions import vectors as V
from tidemark.operators import changelog, hybrid, ivf, postings, search, sqlapi
from tidemark.sources import events
from tidemark.streaming import state as S


@pytest.mark.parametrize("dim", [8, 128, 384, 768])
def test_quantised_dot_is_near(spark, dim):
    draw = np.random.default_rng(dim)
    a, b = draw.uniform(-1, 1, (2, dim)).tolist()
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(V.dot(F.col("a"), F.col("b")).alias("d"), V.q8_dot(V.q8_quantize(F.col("a")), V.q8_quantize(F.col("b"))).alias("q")).first()
    assert abs(row.d - np.dot(a, b)) < 1e-3 and abs(row.q - row.d) <= 0.05 * abs(row.d) + 0.05


def test_embed(spark):
    texts = ["TEST_VEC:1.0, 0.5", "TEST_VEC:1.0,x", "other"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(V.embed(F.col("t")).alias("v")).collect()
    assert rows[0].v == [1.0, 0.5] and len(rows[1].v) == len(rows[2].v) == 384 and all(0 <= x < 1 for x in rows[2].v)


def test_json_filters(spark):
    rows = spark.createDataFrame([('{"a":"x","b":[1,{"c":2}]}',), ("[]",), ("broken",), (None,)], "j string")
    n = lambda w: rows.where(jsons.matches(F.col("j"), w)).count()
    assert (n(None), n({}), n("[1]"), n({"a": "x"}), n({"a": None}), n({"z": None}), n({"b": [1, {"c": 2}]}), n({"b": [1]})) == (4, 1, 0, 1, 0, 0, 1, 0)


def test_rows_as_json(spark):
    frame = spark.sql("SELECT 1 AS a, double('NaN') AS x, unhex('FF01') AS b, 2 AS a, CAST(NULL AS STRING) AS s")
    assert json.loads(jsons.json_rows(frame).first().row) == {"a": 2, "x": None, "b": "/wE", "s": None}


def test_index_candidates(spark):
    docs = spark.createDataFrame([("1", '{"a":"x","n":1}'), ("2", '{"a":"x","b":"y"}'), ("3", "[]")], "id string, doc string")
    index = postings.build(docs)
    assert [r.id for r in postings.candidates(index, {"a": "x", "b": "y"}).collect()] == ["2"]
    assert not postings.usable({"n": 1}) and not postings.usable({})
    assert postings.lists(index).count() == 2


def test_gaps_over_ranges(spark):
    log = spark.createDataFrame([(o,) for o in (1, 2, 5, 6, 90, 200)], "offset long")
    for parts in (1, 7, 64):
        assert sorted(tuple(r) for r in changelog.gaps(log, partitions=parts).collect()) == [(3, 4, 2), (7, 89, 83), (91, 199, 109)]
    assert changelog.gaps(log.where("offset < 0")).isEmpty()


def test_batch_blocks_and_ties(spark):
    items = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(50)] + [(99, [1.0])], "id long, vector array<float>").repartition(5)
    queries = pd.DataFrame({"query_id": [0, 1, 2], "vector": [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]})
    one = sorted(map(tuple, search.batch(items, queries, 4).collect()))
    assert one == sorted(map(tuple, search.batch(items, queries, 4, block=1).collect()))
    assert [r[1] for r in one if r[0] == 0] == [0, 3, 6, 9] and [r[1] for r in one if r[0] == 2] == [0, 1, 2, 3]


def test_clusters_separate(spark):
    rows = [(i, [1.0, 0.05 * (i % 3)] if i % 2 == 0 else [0.05 * (i % 3), 1.0], "a" if i % 2 == 0 else "b") for i in range(32)]
    items = spark.createDataFrame(rows, "id long, vector array<float>, c string")
    settings = IndexSettings(clusters=2, nprobe=1, min_train=2)
    cents = ivf.train(items, settings)
    for q, c in (([1.0, 0.0], "a"), ([0.0, 1.0], "b")):
        assert {r.c for r in ivf.probe(ivf.assign(items, cents), cents, search.literal(q), 4, settings).collect()} == {c}
    assert ivf.train(items, IndexSettings(clusters=64)) is None


def test_fusion(spark):
    a = spark.createDataFrame([("1", 1, "va"), ("2", 2, "vb")], "id string, rank int, payload string")
    b = spark.createDataFrame([(2, 1, "sb"), (3, 2, "sc"), (None, 3, "sd")], "id int, rank int, payload string")
    rows = [(r.id, round(r.rrf_score, 9), r.payload) for r in hybrid.fused([a, b]).collect()]
    assert rows == [("2", round(1 / 62 + 1 / 61, 9), "vb"), ("1", round(1 / 61, 9), "va"), ("3", round(1 / 62, 9), "sc")]


def test_dialect(spark):
    assert sqlapi.rewritten("SELECT max(a, 1), max(a), 'max(x,y) like' FROM t WHERE b LIKE 'x%'") == "SELECT greatest(a, 1), max(a), 'max(x,y) like' FROM t WHERE b ILIKE 'x%'"
    got = spark.sql(sqlapi.rewritten("SELECT total(x) AS t, iif(1 < 2, 'a', 'b') AS i FROM (SELECT 1 AS x WHERE 1 = 0)")).first()
    assert (got.t, got.i) == (0.0, "a")


def write_lines(path, *lines):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir())):04d}.json").write_text("\n".join(lines))


def event(o, type_="state_updated", **data):
    return json.dumps({"offset": o, "ts_ms": o, "type": type_, "data": json.dumps(data)})


def test_event_log_with_torn_lines(spark, tmp_path):
    write_lines(tmp_path / "log", event(1, key="a", value="1"), "", event(2, "state_deleted", key="a"), event(3, key="b", value="2"), '{"offset": 4, "ts')
    log = events.read(spark, str(tmp_path / "log"), since=0)
    assert sorted(r.offset for r in log.collect()) == [1, 2, 3]
    assert events.filtered(log, types=" state_deleted ,x").count() == 1 and events.filtered(log, types="").count() == 0
    assert events.filtered(log, key_prefix="b").count() == 1 and events.filtered(log, collection="c").count() == 0


def test_stream_fold_resumes(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    write_lines(tmp_path / "log", event(1, key="a", value="1"), event(2, key="b", value="1"))
    assert S.fold(spark, log, out, check).count() == 2
    write_lines(tmp_path / "log", event(3, "state_deleted", key="a"), event(4, key="b", value="2"))
    assert [(r.key, r.value) for r in S.fold(spark, log, out, check).collect()] == [("b", "2")]


def test_stream_gaps(spark, tmp_path):
    write_lines(tmp_path / "log", event(1), event(2), event(5))
    found = S.gaps(events.stream(spark, str(tmp_path / "log")).withColumn("log", F.lit("l")))
    q = found.writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("gaps").collect()] == [("l", 3, 4, 2)]


def test_compaction_trigger(spark):
    runs = spark.createDataFrame([(10, 1), (10, 4)], "records long, tombstones long")
    need = lambda n, r: changelog.needs_compaction(runs, n, r).first().compact
    assert need(1, 0.0) and not need(2, 0.0) and need(2, 0.25) and not need(2, 0.3)
    assert not changelog.needs_compaction(runs.where("false"), 1, 0.5).first().compact
