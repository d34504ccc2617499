"""Operators that learn: held-out accuracy, parts against plain versions, edges."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, quality, toxicity
from tidemark.llm.queries import fold
from tidemark.llm.runtime import Scratch
from tidemark.llm.shingles import string_chunks, word_table

WORDS = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "re") for b in ("n", "st", "l") for c in ("a", "or", "ing", "es")]


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        toxic, good = int(draw.random() < 0.2), int(draw.random() < 0.7)
        text = draw.choices(WORDS, k=draw.randrange(20, 200))
        if toxic:
            for _ in range(max(1, len(text) // 30)):
                text[draw.randrange(len(text))] = draw.choice(("vileword", "nastier", "nastiest!", "Vileword"))
        if not good:
            text = [w + draw.choice(("%%%", "###")) for w in text] if draw.random() < 0.5 else [text[0]] * len(text)
        docs.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, labelled, edge, nothing):
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels, fold(4) != 2)
    rows = toxicity.score(docs, lexicon).join(labels, "doc_id").where(fold(4) == 2).collect()
    right = sum((r.score >= 0.3) == bool(r.toxic) for r in rows)
    assert len(rows) > 100 and right >= 0.95 * len(rows)
    scored = toxicity.score(edge, lexicon).collect()
    assert len(scored) == edge.count() and all(r.segments == [] and r.score < 0.3 for r in scored if r.n_words == 0)
    assert toxicity.score(nothing, lexicon).isEmpty()
    hit = toxicity.score(spark.createDataFrame([(1, "fine words here vileword nastiest end")], "doc_id long, text string"), lexicon).first()
    assert [(s["first"], s["last"]) for s in hit.segments] == [(3, 4)] and hit.segments[0].evalue < 0.1
    # without labels of both kinds nothing is learned, and all score the same
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))).collect()}) == 1


def test_words_are_told_apart_by_all_their_bytes():
    words = ["donaudampfschifffahrt", "donaudampfschiffskapitaen", "a" * 40, "a" * 41, "vile"]
    for texts in (words, [" ".join(words)], ["".join(f"{w}1" for w in words)]):
        whole = []
        for _, data, offsets in string_chunks(pa.array(texts, pa.string())):
            starts, lengths, _ = toxicity.letter_words(data, offsets)
            *_, (at, h) = toxicity.tokens(data, starts, lengths)
            whole += h.tolist()
        assert len(set(whole)) == len(words)
    assert list(toxicity.tokens(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == []


def test_odds_and_calibration_equal_brute_force(spark):
    draw = random.Random(12)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = draw.choices(WORDS, k=draw.randrange(5, 60)) + (["vile"] * draw.choice((1, 2, 30)) if toxic or draw.random() < 0.01 else [])
        draw.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(frame, known, F.lit(True))
    third = {r.doc_id for r in frame.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(3)) == 0).collect()}

    def grams(word):
        return [word[:k] for k in toxicity.PREFIXES if len(word) > k] + [f"{word}$"]

    counts, in_texts = {}, {}
    for (i, text), (_, y) in zip(docs, labels, strict=True):
        if i not in third:
            for g, times in collections.Counter(g for w in text.split() for g in grams(w)).items():
                counts.setdefault(g, [0, 0])[y] += round(4000 * math.log(1 + times / 4))
                in_texts.setdefault(g, [0, 0])[y] += 1
    n = [sum(c[y] for c in counts.values()) for y in (0, 1)]
    odds = {}
    for g, (n0, n1) in counts.items():
        own, own_texts = toxicity.PRIOR * (n0 + n1), toxicity.PRIOR * sum(in_texts[g])
        rate = [math.log((c + own) / (m + toxicity.PRIOR * sum(n) - c - own)) for c, m in ((n0, n[0]), (n1, n[1]))]
        odds[g] = rate[1] - rate[0] - 1.64 * math.sqrt(1 / (in_texts[g][1] + own_texts) + 1 / (in_texts[g][0] + own_texts))
    kept = {g: v for g, v in odds.items() if v >= toxicity.LEAST}
    assert kept and sorted(np.round(lexicon.odds, 9)) == sorted(np.round(list(kept.values()), 9))

    gap = math.log(1 - toxicity.MIX)
    scores = lambda text: [math.log(1 - toxicity.MIX + toxicity.MIX * math.exp(max(v))) if (v := [kept[g] for g in grams(w) if g in kept]) else gap for w in text.split()]
    lowest = math.log(1 - toxicity.MIX + toxicity.MIX * math.exp(min(kept.values())))
    clean = [scores(t) for (i, t), (_, y) in zip(docs, labels, strict=True) if i in third and not y]
    found = [lexicon.segments([i for i, v in enumerate(s) if v != gap], [v for v in s if v != gap]) for s in clean]
    k = (1 + sum(map(len, found))) / (1 + sum(map(len, clean)) * math.exp(-lowest))
    assert lexicon.k == pytest.approx(k)
    for row in toxicity.score(frame, lexicon).collect():
        s = scores(docs[row.doc_id][1])
        best = max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        assert row.best == pytest.approx(max(best, 0), abs=1e-9)
        for part in row.segments:
            assert part["evalue"] == pytest.approx(min(1.0, lexicon.k * len(s) * math.exp(-part["score"])))


def test_the_scan_takes_linear_time():
    class Steps(list):
        n = 0

        def __getitem__(self, i):
            Steps.n += 1
            return list.__getitem__(self, i)

    lexicon = toxicity.Lexicon()
    source = __import__("inspect").getsource(toxicity.Lexicon.segments).replace("= []", "= Steps()")
    space = {"math": math, "Steps": Steps}
    exec(__import__("textwrap").dedent(source), space)
    draw = random.Random(1)
    for gaps in ([400] * 100_000, [draw.choice((1, 5, 400)) for _ in range(100_000)], list(range(100_000, 0, -1)), list(range(100_000))):
        hits = np.cumsum(gaps).tolist()
        scores = [draw.choice((0.4, 1.5, 3.9)) for _ in hits]
        Steps.n = 0
        found = space["segments"](lexicon, hits, scores)
        assert Steps.n <= 6 * len(hits) and found == lexicon.segments(hits, scores)


def test_segments_equal_brute_force():
    lexicon = toxicity.Lexicon(mix=0.1)
    gap = math.log(0.9)

    def plain(scores):
        """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
        best, at = 0.0, None
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > best + 1e-12:
                    best, at = total, (i, j)
        if at is None:
            return []
        i, j = at
        return plain_part(scores, 0, i) + [(i, j, best)] + plain_part(scores, j + 1, len(scores))

    def plain_part(scores, a, b):
        return [(i + a, j + a, s) for i, j, s in plain(scores[a:b])]

    draw = random.Random(9)
    for _ in range(300):
        n = draw.randrange(1, 40)
        scores = [draw.choice((0.3, 0.5, 1.1)) * (1 + draw.random() / 1000) if draw.random() < 0.3 else gap for _ in range(n)]
        hits = [i for i, s in enumerate(scores) if s > 0]
        got = lexicon.segments(hits, [scores[i] for i in hits])
        expected = plain(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in got], [s for *_, s in expected])


def test_quality_held_out(labelled, edge, nothing):
    docs, labels = labelled
    rows = quality.score(docs, labels, fold(5) != 0).join(labels, "doc_id").where(fold(5) == 0).collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all((r.score >= 0.3) == r.predicted for r in rows)
    assert quality.score(edge, labels, F.lit(True)).count() == edge.count()
    assert quality.score(nothing, labels, F.lit(True)).isEmpty()
    assert {r.score for r in quality.score(edge, labels.where("1 = 0"), F.lit(True)).collect()} == {0.3}


def test_features_don_t_depend_on_the_batch():
    texts = ["A b c!! DD ee, ff.\ngg", "", "| a | b |", "x x x x", None, "é" * 30]
    whole = quality.features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts]))
    at = {f: i for i, f in enumerate(quality.FEATURES)}
    assert whole[3, at["repeated"]] == 0.75 and whole[3, at["top_word"]] == 1 and whole[2, at["lone_symbols"]] == 0.6 and not whole[1].any()


def test_ranking_prefers_the_good():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(0.5, 1, (300, 3)), draw.normal(-0.5, 1, (200, 3))
    rank = quality.bradley_terry(good, bad)
    assert (rank.raw(good)[:, None] > rank.raw(bad)).mean() > 0.8 and 0 <= rank.quantile <= 1


def plain_features(text):
    """The features of a text as their names say, with strings and loops."""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return [0.0] * len(quality.FEATURES)
    raw = [w.encode() for w in words]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in raw]
    n, size, data = len(words), len(text.encode()), text.encode()
    lengths = [len(w) for w in raw]
    mean = sum(lengths) / n
    symbol = {b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-"}
    share = lambda it: sum(it) / n
    top = collections.Counter(low).most_common(1)[0][1]
    return [
        math.log(1 + n), mean, math.sqrt(max(0, sum(x * x for x in lengths) / n - mean**2)), share(x > 20 for x in lengths), share(low[i] == low[i - 1] for i in range(1, n)), share(low[i] == low[i - 2] for i in range(2, n)),
        len(set(low)) / n**0.9, top / n, sum(b in symbol for b in data) / size * 10, share(w[-1] in symbol for w in raw), share(len(w) == 1 and w[0] in symbol for w in raw), data.count(b"!") / n,
        sum(65 <= b <= 90 for b in data) / size * 10, sum(48 <= b <= 57 for b in data) / size * 10, sum(b >= 128 for b in data) / size * 10, sum(b in b".?" for b in data) / n * 10, sum(b in b",;:" for b in data) / n * 10,
        math.log(1 + n / (data.count(b"\n") + 1)),
    ]


def test_quality_equals_brute_force(spark, small):
    """Features, stationary weights, the best quantile and the scores of the whole query, by loops over all documents."""
    from tidemark.llm import queries

    docs = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    x = {d: np.array(plain_features(t)) for d, t in docs.items()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, small, "labels").collect() if r.doc_id in docs}
    train = {d: y for d, y in labels.items() if __import__("zlib").crc32(str(d).encode()) % 5 != 0}
    got = {r.doc_id: r for r in quality.score(queries.table(spark, small, "documents"), queries.table(spark, small, "labels"), fold(5) != 0).collect()}
    good, bad = (np.array([x[d] for d in sorted(train) if train[d] == y]) for y in (1, 0))
    rank = quality.bradley_terry(good, bad)
    every = np.concatenate((good, bad))
    mean, sd = every.mean(axis=0), every.std(axis=0) + 1e-9
    z = {d: np.clip((v - mean) / sd, -8, 8) for d, v in x.items()}
    draw, n = np.random.default_rng(1), min(quality.PAIRS, len(good) * len(bad))
    losers = draw.integers(len(bad), size=n)
    zg, zb = (np.clip((v - mean) / sd, -8, 8) for v in (good, bad))
    gradient = np.zeros(len(mean))
    for i in range(n):
        d = zg[i % len(good)] - zb[losers[i]]
        gradient -= d / (1 + math.exp(min(max(float(d @ rank.weights), -30), 30)))
    assert np.abs(gradient / n + 1e-3 * rank.weights).max() < 1e-6
    raw = {d: float(z[d] @ rank.weights) for d in docs}
    right = lambda cut: sum((raw[d] >= cut) == bool(y) for d, y in train.items())
    held = sorted(raw[d] for d in train)
    best = max(right(cut) for cut in [*held, held[-1] + 1])
    assert right(rank.shift) >= best - 1
    for d, r in got.items():
        assert r.raw == pytest.approx(raw[d], abs=1e-6) and r.predicted == (r.score >= 0.3)
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(raw[d] - rank.shift + math.log(0.3 / 0.7), -40), 40))), abs=1e-6)


def test_repeated_ids_train_one_way(spark, labelled):
    docs, labels = labelled
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' %%% other')"))
    a, b = (sorted(tuple(r) for r in quality.score(twice.repartition(n), labels, F.lit(True)).collect()) for n in (1, 6))
    assert a == b


def sides(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_pseudo_likelihood(spark, edge, nothing):
    draw = random.Random(4)
    follow = {w: draw.sample(WORDS, 2) for w in WORDS}

    def chain(n):
        out = [draw.choice(WORDS)]
        while len(out) < n:
            out.append(draw.choice(follow[out[-1]]))
        return out

    texts = [chain(300) for _ in range(150)]
    shuffled = [draw.sample(t, len(t)) for t in texts[:20]]
    # the shuffled texts have the same words, so only their order can tell them apart
    scored = {r.doc_id: r for r in lm.score(sides(spark, [" ".join(t) for t in texts + shuffled])).collect()}
    assert np.mean([scored[i].per_word for i in range(20)]) > np.mean([scored[150 + i].per_word for i in range(20)]) + 0.2
    rows = lm.score(edge).collect()
    assert len(rows) == edge.count() and all(r.per_word is None and r.log_prob == 0 for r in rows if r.n_words == 0)
    assert len({r.log_prob for r in rows if r.doc_id == 6}) == 1 and lm.score(nothing).isEmpty()


def test_pseudo_likelihood_equals_a_plain_sum(spark):
    texts = ["a b c a b d e", "b", "c c c a " * 20]
    scratch = Scratch(spark, "t")
    vocab = lm.vocabulary(sides(spark, texts), scratch)
    net = {k: v.astype(np.float64) for k, v in lm.start(1, vocab.prior).items()}
    for text in texts:
        (_, data, offsets), = string_chunks(pa.array([text]))
        words, _, first = word_table(data, offsets)
        classes = vocab.classes(words).tolist()
        total = 0.0
        for i, c in enumerate(classes):
            near = [classes[j] if 0 <= j < len(classes) else lm.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.maximum(np.concatenate([net["embed"][k] for k in near]) @ net["w1"] + net["b1"], 0)
            z = h @ net["w2"] + net["b2"]
            total += z[c] - math.log(np.exp(z).sum())
        total += vocab.within(words, np.array(classes)).sum()
        assert abs(lm.log_probabilities(net, vocab, words, first).sum() - total) < 1e-6


def test_training_lowers_the_loss():
    draw = np.random.default_rng(0)
    target = draw.integers(0, 4, 4000)
    context = np.stack([target, target, (target + 1) % 4, target], axis=1)
    net = lm.start()
    square = {k: np.full(s, 1e-4, np.float32) for k, s in lm.SHAPES.items()}
    loss = lambda: -lm.forward(net, context)[2][np.arange(len(target)), target].mean()
    before = loss()
    for i in range(0, 4000, 100):
        lm.train(net, square, context[i : i + 100], target[i : i + 100])
    assert loss() < before / 4


def test_gradient_equals_differences():
    draw = np.random.default_rng(1)
    context, target = draw.integers(0, lm.CLASSES + 1, (6, 4)), draw.integers(0, lm.CLASSES, 6)
    net = {k: v.astype(np.float64) + 0.01 for k, v in lm.start().items()}
    loss = lambda n: -lm.forward(n, context)[2][np.arange(6), target].mean()
    stepped = {k: v.copy() for k, v in net.items()}
    square = {k: np.full(s, 1e12) for k, s in lm.SHAPES.items()}
    lm.train(stepped, square, context, target)
    for k in lm.SHAPES:
        i = np.unravel_index(np.argmax(np.abs(stepped[k] - net[k])), net[k].shape)
        gradient = (net[k][i] - stepped[k][i]) / lm.RATE * 1e6
        up, down = ({**net, k: net[k].copy()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - gradient) < 1e-3 * max(abs(gradient), 1e-2)


def test_every_word_has_its_own_count(spark, monkeypatch):
    texts = ["a a a b b c", "b d d d d e", "f " * 30, "g g h i j k a b"] + [" ".join(f"v{i}" for i in range(60))] * 2
    docs = sides(spark, texts)
    whole = [tuple(r) for r in lm.score(docs).orderBy("doc_id").collect()]
    # whether counts come by the broadcast table or by the join, and also where one level alone passes the bound
    for known in (0, 1, 45):
        monkeypatch.setattr(lm, "KNOWN", known)
        got = [tuple(r) for r in lm.score(docs).orderBy("doc_id").collect()]
        assert [r[:2] for r in got] == [r[:2] for r in whole] and np.allclose([r[2] for r in got], [r[2] for r in whole], atol=0.02)


def test_scores_don_t_depend_on_the_split(spark, small, monkeypatch):
    monkeypatch.setattr(lm.fit, "__defaults__", (7, 1_000))  # several shards in a round
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    one, many = ([tuple(r) for r in lm.score(docs.repartition(n)).orderBy("doc_id").collect()] for n in (1, 7))
    assert one == many and sum(r[1] for r in one) > 5 * lm.ROUNDS * 1_000


def test_averaged_weights_equal_a_plain_average(spark):
    """The shards of one round, trained and averaged by hand."""
    draw = random.Random(5)
    docs = sides(spark, [" ".join(draw.choices(WORDS, k=50)) for _ in range(60)])
    scratch = Scratch(spark, "t")
    vocab = lm.vocabulary(docs, scratch)
    got = lm.fit(docs, vocab, scratch, shard=200)
    shards, sizes = {}, {}
    for r in docs.collect():
        _, data, offsets = next(string_chunks(pa.array([r.text])))
        classes = vocab.classes(word_table(data, offsets)[0])
        key = spark.range(1).select(F.xxhash64(F.lit(r.doc_id).cast("long"), F.lit(bytearray(classes.astype(np.uint8).tobytes())))).first()[0]
        sizes[key % lm.ROUNDS] = sizes.get(key % lm.ROUNDS, 0) + len(classes)
        shards.setdefault(key % lm.ROUNDS, []).append((key, classes))
    net, square = lm.start(7, vocab.prior), {k: np.full(s, 1e-4, np.float32) for k, s in lm.SHAPES.items()}
    for n in sorted(shards):
        parts = {}
        for key, classes in sorted(shards[n], key=lambda x: x[0]):
            parts.setdefault((key >> 8) % -(-sizes[n] // 200), []).append(classes)
        found = []
        for held in parts.values():
            own, own_square = ({k: v.copy() for k, v in x.items()} for x in (net, square))
            lm.trained(own, own_square, held, 7 + n)
            found.append((own, own_square, sum(map(len, held))))
        mean = lambda j: {k: np.round(sum(f[j][k].astype(float) * f[2] for f in found) / sum(f[2] for f in found), 7).astype(np.float32) for k in lm.SHAPES}  # noqa: B023, E731
        net, square = mean(0), {k: np.maximum(v, 1e-4).astype(np.float32) for k, v in mean(1).items()}
    for k in lm.SHAPES:
        assert np.abs(net[k] - got[k]).max() < 1e-5


def fingerprints(text):
    (_, data, offsets), = string_chunks(pa.array([text]))
    return word_table(data, offsets)[0]


def test_words_of_a_class_are_told_apart_by_both_sides(spark):
    """Two words of one class that occur equally often, each among words of its own set: changing places lowers the score."""
    draw = random.Random(6)
    sets = [[f"{side}{i}" for i in range(30)] for side in ("ta", "lo")]
    rare = [f"rare{i}" for i in range(100)]
    by_class = {}
    for w in rare:
        by_class.setdefault(int(lm.bucket(fingerprints(w))[0]), []).append(w)
    pair = next(v for v in by_class.values() if len(v) > 1)[:2]
    texts = []
    for i in range(400):
        text = draw.choices(sets[i % 2], k=60)
        if i % 4 < 2:
            text[30] = pair[i % 2]
        texts.append(text)
    swapped = [[{pair[0]: pair[1], pair[1]: pair[0]}.get(w, w) for w in t] for t in texts[:2]]
    scored = {r.doc_id: r.log_prob for r in lm.score(sides(spark, [" ".join(t) for t in texts + swapped])).collect()}
    for i in range(2):
        assert scored[i] > scored[400 + i] + 0.2


@pytest.mark.parametrize("known", [0, 10, 50_000])
def test_scores_equal_a_plain_sum_over_all_words(spark, monkeypatch, known):
    """Each word's chance in its class and state by counts in dictionaries, whether its counts are sent out or joined."""
    monkeypatch.setattr(lm, "KNOWN", known)
    draw = random.Random(8)
    words_ = WORDS + [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choices(words_, [1 / (1 + i) for i in range(len(words_))], k=draw.randrange(80))) for _ in range(150)]
    docs = sides(spark, texts)
    scratch = Scratch(spark, "t")
    vocab = lm.vocabulary(docs, scratch)
    net = lm.fit(docs, vocab, scratch)
    lens = lm.lenses(net, vocab.prior).astype(float)
    seen, n, by_state, of_class, of_state = [], *(collections.Counter() for _ in range(4))
    for d, text in enumerate(texts):
        words = fingerprints(text)
        classes = vocab.classes(words).tolist()
        for i, (w, c) in enumerate(zip(words.tolist(), classes, strict=True)):
            near = [classes[j] if 0 <= j < len(classes) else lm.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
            state = sum(1 << b for b in range(lm.BITS) if sum(lens[k][x][b] for k, x in enumerate(near)) > 0)
            h = np.maximum(np.concatenate([net["embed"][k] for k in near]) @ net["w1"] + net["b1"], 0)
            z = h @ net["w2"] + net["b2"]
            seen.append((d, w, c, state, z[c] - math.log(np.exp(z).sum())))
            n[w] += 1
            by_state[w, state] += 1
            of_class[c] += 1
            of_state[c, state] += 1
    total = collections.Counter()
    for d, w, c, state, log in seen:
        share = (by_state[w, state] + n[w] / lm.STATES) / (of_state[c, state] + of_class[c] / lm.STATES)
        total[d] += log + (math.log(share) if c >= lm.OWN else 0)
    got = {r.doc_id: (r.n_words, r.log_prob) for r in lm.score(docs).collect()}
    assert len(got) == len(texts) and sum(x[0] for x in got.values()) == len(seen)
    for d in got:
        assert got[d][1] == pytest.approx(total[d], abs=1e-3 + 1e-4 * got[d][0])
