"""The graph search against brute force where its walk alone misses items."""

import numpy as np
import pytest

from tests.compare import duck, same
from tidemark.config import IndexSettings
from tidemark.operators import graph, search
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", ["random", "copies"])
def test_exact_search_finds_what_the_walk_misses(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(graph, "SUBGRAPH", 32)
    draw = np.random.default_rng(3)
    x = draw.standard_normal((1500, 24)).astype(np.float32)
    if name == "copies":
        x[300:] = x[np.arange(1200) % 30]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    settings = IndexSettings(degree=8, search_list=8)
    graph.write(graph.build(items, settings), str(tmp_path / "g"))
    found, missed = graph.read(spark, str(tmp_path / "g")), 0
    for i in (2, 40, 77, 1400):
        q = search.literal(x[i].tolist())
        brute = [tuple(r) for r in search.exact(items, q, 10).select("id", "score").collect()]
        assert [tuple(r) for r in graph.topk(found, q, 10, settings, exact=True).collect()] == brute
        missed += len({r[0] for r in brute} - {r.id for r in graph.topk(found, q, 10, settings).collect()})
    assert missed


def test_regions_out_of_reach_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "SUBGRAPH", 16)
    turn = np.linspace(0, np.pi, 400)
    items = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(turn)], "id long, vector array<float>")
    graph.write(graph.build(items, IndexSettings()), str(tmp_path / "g"))
    found = graph.read(spark, str(tmp_path / "g"))
    parts = graph.within(found, np.array([1.0, 0.0]), 0.99)
    near = {r.part for r in found.nodes.where(f"id < {int((turn <= np.arccos(0.99)).sum())}").select("part").distinct().collect()}
    assert near <= set(parts) and len(parts) < found.regions.count() / 2


def test_query_equals_its_sql_in_many_regions(spark, monkeypatch):
    monkeypatch.setattr(graph, "SUBGRAPH", 32)
    d = "/root/testdata/sf0.1"
    same(catalogue.QUERIES["vec_graph_topk"](spark, d), duck(d), catalogue.SQL["vec_graph_topk"])
