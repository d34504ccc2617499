import pytest

import corpus_pipeline
from tests.compare import duck, same
from tests.llm.test_shingles_and_neardup import brute, shingles, words
from tidemark.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), duck(small), queries.SQL[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_contract_columns(spark, small):
    want = {
        "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op6_quality": ["doc_id", "held_out", "score", "predicted"],
        "op4_html": ["page_id", "url", "text", "n_chars"],
        "op8_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    }
    for name, columns in want.items():
        rows = queries.QUERIES[name](spark, small)
        assert rows.columns[: len(columns)] == columns
        source = "pages" if name == "op4_html" else "documents"
        assert rows.count() == queries.table(spark, small, source).count()


def test_stages_on_their_own_input(spark, small):
    """Each stage against a plain version, on what the one before it kept."""
    docs = queries.table(spark, small, "documents")
    bench = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "neardup", "decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, small).cache()
        after = {r.doc_id: r for r in out.collect()}
        assert out.columns[:5] == COLUMNS and (name == "mixing" or out.columns == COLUMNS)
        if name == "neardup":
            rows = brute(sorted((d, r.text) for d, r in before.items()), 80)
            assert set(after) == {c for _, _, c in rows}
        elif name == "decontamination":
            wanted = [(shingles(t), len(words(t))) for _, t in bench]
            leaks = {d for d, r in before.items() if any(100 * len(q & shingles(r.text)) >= 80 * len(q) for q, n in wanted if n >= 5)}
            assert set(after) == set(before) - leaks
        elif name == "toxicity":
            assert set(after) <= set(before)  # so few labels teach little; see test_toxic_documents_go
        else:
            assert set(after) == set(before)
        if name not in ("pii",):
            assert all(after[d].text == before[d].text for d in after)
        docs = spark.createDataFrame(out.select(*COLUMNS).collect(), docs.schema)


def test_toxic_documents_go(spark):
    folder = "/root/testdata/sf0.01"
    docs = queries.table(spark, folder, "documents")
    kept = {r.doc_id for r in corpus_pipeline.clean(spark, docs, folder).select("doc_id").collect()}
    labels = queries.table(spark, folder, "labels").collect()
    toxic, clean = ([r.doc_id for r in labels if r.toxic == t] for t in (1, 0))
    assert sum(d in kept for d in toxic) <= 0.2 * len(toxic) and sum(d in kept for d in clean) >= 0.95 * len(clean)


def test_edges(spark, small, edge, nothing):
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing.select(*COLUMNS), small).isEmpty()
    kept = corpus_pipeline.clean(spark, edge.select(*COLUMNS), small)
    assert kept.where("doc_id IS NULL").count() == 1
    rows = corpus_pipeline.distinct(spark, edge.select(*COLUMNS), small).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, i) for i in (1, 2, 3, 4, 6, 7)] + [(True, 0)]


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and len({(r.slot, r.place) for r in rows}) == len(rows)


def test_rows_go_by_their_own_text(spark, small):
    """Rows that share a doc_id, or have none, stay or go each by itself; columns of any name are kept."""
    from pyspark.sql import functions as F

    item = queries.table(spark, small, "benchmark").first().text
    rows = [(1, item), (1, "a clean text of some words that stays"), (None, f"before {item} after"), (None, "another clean text without an id"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars", "'k' AS key", "2 AS found", "3 AS n_pii", "4 AS `a.b`")
    kept = corpus_pipeline.decontaminated(spark, docs, small)
    assert kept.columns == docs.columns and sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, (rows[1][1], rows[3][1], None, "")))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where(F.lit(False)), small).isEmpty()
        out = stage(spark, docs, small)
        assert set(docs.columns) <= set(out.columns) and out.where("n_pii = 3 AND `a.b` = 4 AND found = 2").count() == out.count() >= 4, name


def test_toxic_rows_without_an_id_go(spark):
    folder = "/root/testdata/sf0.01"
    docs = queries.table(spark, folder, "documents")
    toxic = queries.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    bad = docs.join(toxic, "doc_id", "left_semi").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.clean(spark, docs.union(bad), folder)
    assert kept.where("doc_id IS NULL").count() <= 0.2 * bad.count()
