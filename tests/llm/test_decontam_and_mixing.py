import random

from pyspark.sql import functions as F

from tests.llm.test_shingles_and_neardup import shingles, words
from tidemark.llm import decontam, mixing


def test_contained_items_equal_brute_force(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice((1, 3, 5, 6, 9, 20, 70))))) for i in range(40)] + [(40, ""), (41, None), (0, "w1 w2")]
    docs = []
    for d in range(60):
        text = draw.choices(vocabulary, k=draw.choice((0, 4, 30, 3000)))
        for i, t in draw.sample(items[:40], 3):
            part = [w if draw.random() > 0.02 else "changed" for w in t.upper().split()]
            at = draw.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, " \n".join(text)))

    def contains(text, item):
        w, q = words(text), words(item)
        if not q:
            return None
        if len(q) < 5:
            have = {tuple(w[i : i + len(q)]) for i in range(len(w) - len(q) + 1)}
        else:
            have = shingles(text)
        want = shingles(item)
        n = len(want & have)
        return (len(want), n) if 100 * n >= 80 * len(want) else None

    expected = sorted((d, i, *c) for d, t in docs for i, q in items if (c := contains(t, q)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 64):
        got = decontam.contaminated(frame, bench, block=block)
        assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()) == expected
    kept = decontam.without_contaminated(frame, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - {e[0] for e in expected} and kept.columns == frame.columns


def test_edges_of_decontamination(spark, edge, nothing):
    bench = spark.createDataFrame([(1, "doc without an id but"), (None, "one"), (3, " ")], "item_id long, text string").withColumn("doc_id", F.lit(5))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(edge, bench).collect()} == {(None, 1), (4, None)}
    assert decontam.contaminated(nothing, bench).isEmpty() and decontam.contaminated(edge, bench.where("1 = 0")).isEmpty()
    assert decontam.without_contaminated(edge, bench).count() == edge.count() - 1


def shares_of(spark, units, slots):
    return mixing.period(spark.createDataFrame(list(units.items()), "source string, units long"), slots).collect()


def test_schedule_deviates_by_less_than_a_block(spark):
    draw = random.Random(1)
    for units, slots in (({"a": 1, "b": 1}, 10), ({"a": 900, "b": 50, "c": 45, None: 5}, 100), ({f"s{i}": draw.randrange(1, 100) for i in range(23)}, 500), ({"x": 5}, 7), ({"a": 10**6, "b": 10, "c": 10, "d": 15 * 10**4}, 9)):
        rows = sorted(shares_of(spark, units, slots), key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(slots))
        share = {r.source: r.share for r in rows}
        assert sum(share.values()) == slots and set(share) == set(units)
        placed = dict.fromkeys(units, 0)
        for t, r in enumerate(rows):
            assert r.release <= r.slot < r.deadline
            placed[r.source] += 1
            assert all(abs(placed[s] * slots - share[s] * (t + 1)) < slots for s in units)


def test_mixture(spark, edge, nothing):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "rare" if i % 2 else None, f"t{i}") for i in range(3000)], "doc_id long, source string, text string")
    one = mixing.mix(docs, {"big": 8, "rare": 1}, slots=10, block_rows=4, ranked=10)
    rows = one.orderBy("slot", "place").collect()
    assert len(rows) == 3000 and len({r.doc_id for r in rows}) == 3000
    # whatever the parts, the same order
    other = mixing.mix(docs.repartition(7), {"big": 8, "rare": 1}, slots=10, block_rows=4, ranked=10**9)
    assert [r.doc_id for r in other.orderBy("slot", "place").collect()] == [r.doc_id for r in rows]
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.block, r.place))
    assert all(v == [(i // 4, i % 4) for i in range(len(v))] for v in by.values())
    first = [r for r in rows if r.slot < 100]
    assert {s: sum(r.source == s for r in first) for s in ("big", "rare", None)} == {"big": 320, "rare": 40, None: 40}
    clash = mixing.mix(edge.selectExpr("*", "1 AS t_slots", "2 AS cell", "3 AS src", "4 AS before", "5 AS rows"))
    assert clash.count() == edge.count() and dict(clash.dtypes)["slot"] == "bigint" and {"key", "Found", "component"} <= set(clash.columns)
    assert mixing.mix(nothing).isEmpty()


def test_many_sources(spark):
    # more sources than half a period, than a period, and small ones that take more than the largest has
    for units, slots, longer in (({f"s{i:03}": 1 + (i == 5) * 9 for i in range(8)}, 10, 10), ({f"s{i:03}": 1 + i % 3 for i in range(700)}, 1000, 1000), ({f"s{i:03}": 3 for i in range(25)}, 10, 50), ({f"s{i:03}": v for i, v in enumerate([13] * 7 + [55] * 2 + [1] * 11)}, 20, 40)):
        frame = spark.createDataFrame(list(units.items()), "source string, units long")
        assert mixing.enough(frame, slots) == longer
        rows = sorted(mixing.period(frame, longer).collect(), key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(longer)) and {r.source for r in rows} == set(units)
        assert all(r.release <= r.slot < r.deadline for r in rows)
    docs = spark.range(2400).selectExpr("id AS doc_id", "concat('site', id % 600 * (id % 2)) AS source")
    docs = docs.union(spark.range(2400, 3600).selectExpr("id", "concat('other', id)"))
    rows = mixing.mix(docs).collect()
    assert len({r.doc_id for r in rows}) == 3600 and len({(r.slot, r.place) for r in rows}) == 3600
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_no_python_in_the_native_operators(spark, edge):
    from tidemark.llm.pii import pseudonymise

    for frame in (mixing.mix(edge), pseudonymise(edge, "k")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rows_that_agree_in_doc_id_have_one_order(spark):
    rows = [(i % 5, "s", f"text {i}") for i in range(300)] + [(None, None, f"n{i}") for i in range(50)]
    orders = []
    for parts in (1, 6):
        mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts), ranked=20)
        orders.append([r.text for r in mixed.orderBy("slot", "place").collect()])
    assert orders[0] == orders[1] and len(set(orders[0])) == 350


def test_a_large_benchmark_gives_the_same_rows(spark, edge, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text").union(docs.select("doc_id", "text").limit(20)).union(edge.select("doc_id", "text"))
    bench = bench.select("item_id", "text").union(bench.select("item_id", "text").limit(3)).union(spark.createDataFrame([(None, "one"), (7, "w x"), (8, None)], "item_id long, text string"))
    one, other = (sorted(map(str, decontam.contaminated(docs, bench, block=b).collect())) for b in (decontam.BLOCK, 10))
    assert one == other and len(one) > 2
