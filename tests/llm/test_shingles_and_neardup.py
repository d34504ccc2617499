import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import components as C
from tidemark.llm import neardup
from tidemark.llm.runtime import Scratch
from tidemark.llm.shingles import shingle_sets


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    """Components by comparing all pairs of a small table."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aAbZ é\t\n\x0b  ß.", max_size=60), max_size=8))
def test_set_sizes_equal_those_of_the_definition(texts):
    for chunk in (1, 7, 1 << 20):
        got = [len(s) for s in shingle_sets(pa.array(texts, pa.string()), chunk_bytes=chunk)]
        assert got == [len(shingles(t)) for t in texts]


def test_equal_shingles_have_equal_prints():
    a, b = shingle_sets(pa.array(["x a b c d e f y", "A B c d E f"]))
    assert len(set(a.tolist()) & set(b.tolist())) == 2


def family(draw, base, n, rate):
    for _ in range(n):
        yield " ".join(draw.choice("abcdefghijklmnop") * 4 + str(draw.random()) if draw.random() < rate else w for w in base)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_components_equal_brute_force(spark, percent):
    draw = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size, n in ((8, 6), (30, 10), (120, 25), (700, 12), (1500, 6)):
        base = draw.choices(vocabulary, k=size)
        texts += family(draw, base, n, draw.choice((0.005, 0.01, 0.02)))
    passage = draw.choices(vocabulary, k=60)
    texts += [" ".join(passage + draw.choices(vocabulary, k=draw.choice((5, 20, 200)))) for _ in range(40)]
    texts += [t.upper() for t in texts[:5]] + ["a b", "a  B", "b a", "", None, " ", "a b c d e"]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_edges(spark, edge, nothing):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(edge).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 7, None, True), (6, 5, 6, True)} <= rows
    assert neardup.near_duplicates(edge).count() == edge.count()
    assert neardup.near_duplicates(nothing).isEmpty()


def test_floor_bounds_the_chance():
    for percent in (80, 85):
        for k in (32, 64, 512):
            from math import comb

            p, low = percent / 100, neardup._floor(percent, k)
            assert sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(low)) < 1e-6


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(7, 7), (8, 7)]
    got = C.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"))
    assert {(r.node, r.component) for r in got.collect()} == {(i, 100) for i in range(100, 141)} | {(i, 7) for i in range(7, 60)}
    assert got.count() == 94


def candidates(spark, rows, percent):
    """Pairs that are looked at, of either kind, and links found."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    sets = scratch.write(docs.mapInArrow(neardup._sets(5), "doc_id long, n long, s array<long>, bits array<long>"))
    lists = scratch.write(neardup._lists(sets, percent))
    stars = scratch.write(neardup._stars(lists, percent))
    links = neardup._linked(stars, sets, percent, scratch)
    others = scratch.write(neardup._others(lists, neardup._labels(links), sets, percent, scratch))
    return stars.count() + others.count(), links.count() + neardup._linked(others, sets, percent, scratch).count()


def templated(n, draw, words=300):
    """Documents on one template, each with 12 to 20 % of words of its own in one run at a place that varies: 0.7 to 0.84 similar."""
    base = [f"t{i}" for i in range(words)]
    for d in range(n):
        own, at = draw.randint(int(words * 0.093), int(words * 0.14)), draw.randrange(0, words, 25)
        yield d, " ".join(base[:at] + [f"d{d}x{i}" for i in range(own)] + base[at:])


def test_a_template_costs_pairs_in_proportion(spark):
    draw = random.Random(3)
    few, none = candidates(spark, list(templated(250, draw)), 85)
    many, still_none = candidates(spark, list(templated(2000, draw)), 85)
    assert none == still_none == 0
    assert many <= 2 * 2000 and many <= 10 * max(few, 250)


def test_long_lists_are_dealt_without_loss(spark, monkeypatch):
    draw = random.Random(4)
    rows = list(templated(60, draw, 120))
    base = " ".join(f"t{i}" for i in range(120))
    rows += [(100 + i, base + f" end{i // 3} x") for i in range(30)] + [(200 + i, base.replace("t50 ", f"u{i} ") + " " + " ".join(f"v{i}{j}" for j in range(5))) for i in range(40)]
    expected = brute(rows, 85)
    for together in (4, 16):
        monkeypatch.setattr(neardup, "TOGETHER", together)
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected


def test_members_that_only_resemble_their_source(spark):
    """A source and copies that are similar enough to it but not to each other, between other families."""
    draw = random.Random(6)
    texts = []
    for f in range(3):
        base = [f"f{f}w{draw.randrange(2000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for c in range(30):
            at = draw.sample(range(0, 195, 5), 3)
            texts.append(" ".join(w if not any(a <= i < a + 3 for a in at) else f"c{f}x{c}x{i}" for i, w in enumerate(base)))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, 80)


def test_sampled_sketches_find_long_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "K", 512)
    draw = random.Random(8)
    texts = []
    for _ in range(4):
        base = draw.choices([f"w{i}" for i in range(3000)], k=1500)
        texts += family(draw, base, 8, 0.01)
    rows = list(enumerate(texts))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, 85)
