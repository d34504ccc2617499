import pytest

from tests.compare import duck, same
from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, small, con, name):
    same(catalogue.QUERIES[name](spark, small), con, catalogue.SQL[name])


def test_cluster_recall(spark, small):
    assert catalogue.QUERIES["vec_ivf_recall"](spark, small).first().recall >= 0.8


def test_graph_finds_the_nearest(spark, small):
    assert catalogue.QUERIES["vec_graph_topk"](spark, small).first().id == 2


def test_entry_works_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
