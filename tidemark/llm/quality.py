"""Document quality by Bradley-Terry ranking over surface features.

Every text gets ``FEATURES`` from its whole text in one pass.  Of labelled texts, each good one is preferred to each bad one:
in a pair the good text wins with the logistic probability of the weighted difference of features (Bradley and Terry,
1952), and the weights minimise the logistic loss over all pairs of all labelled texts.  The weighted sum of features is a
text's score.  The decision is the cut that separates the labelled scores best; scores are put on 0 to 1 so that it lies at ``CUT``.

The loss depends on the pairs through differences of scores alone.  One pass over the rows spreads each to the ``NODES``
Chebyshev points of its unit of the score, by the weights of polynomial interpolation; sums over all pairs become sums over
pairs of points.  The logistic function has no pole nearer than pi, so these differ from the sums over all pairs by less than
1e-10 of a pair.  Where there are at most ``PAIRS`` pairs, as many are drawn as there are, in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, texts, tune
from .shingles import string_chunks, word_table

FEATURES = (
    "log_words", "mean_word", "sd_word", "long_words", "repeated", "repeated_2", "distinct", "top_word", "symbols", "symbol_ends",
    "lone_symbols", "shouts", "upper", "digits", "non_ascii", "stops", "commas", "line_words",
)
CUT = 0.3
#: Beyond so many pairs the weights come from all of them, without drawing.
PAIRS = 200_000
#: Points of a unit of the score, and steps of the hat functions to a unit that the Newton matrix is summed by.
NODES, HATS = 12, 2
#: Labelled rows that a task takes at once, and rows of a task.
CHUNK, TASK = 16_384, 32_768
#: Units of a score in which cuts are told apart.
UNIT = 1e-9

_CLASS = {name: np.zeros(256, dtype=np.float64) for name in ("upper", "digit", "high", "symbol", "stop", "comma", "line", "shout")}
_CLASS["upper"][65:91] = 1
_CLASS["digit"][48:58] = 1
_CLASS["high"][128:] = 1
_CLASS["symbol"][[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-"]] = 1
_CLASS["stop"][[ord(c) for c in ".?"]] = 1
_CLASS["comma"][[ord(c) for c in ",;:"]] = 1
_CLASS["line"][10] = 1
_CLASS["shout"][ord("!")] = 1


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; of a text without words all are 0."""
    out = []
    for _, data, offsets in string_chunks(column):
        words, starts, first = word_table(data, offsets)
        n_texts = len(offsets) - 1
        x = np.zeros((n_texts, len(FEATURES)))
        out.append(x)
        if not len(words):
            continue
        # ends: the byte before the white space or the text's end that follows a word
        bounds = np.append(starts[1:], len(data))
        solid = np.cumsum(np.concatenate(([0], ((data != 32) & ((data < 9) | (data > 13))).astype(np.int64))))
        length = (solid[bounds] - solid[starts]).astype(float)
        last = data[starts + length.astype(np.int64) - 1]
        owner = np.repeat(np.arange(n_texts), np.diff(first))
        n = np.diff(first).astype(float)
        have = n > 0
        some = np.maximum(n, 1)
        size = np.maximum(np.diff(offsets).astype(float), 1)
        per_word = lambda w: np.bincount(owner, weights=w, minlength=n_texts) / some  # noqa: B023, E731
        sums = {k: np.diff(np.concatenate(([0.0], np.cumsum(t[data])))[offsets]) for k, t in _CLASS.items()}
        mean = per_word(length)
        same = np.concatenate(([False], (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])))
        two = np.concatenate(([False, False], (words[2:] == words[:-2]) & (owner[2:] == owner[:-2])))[: len(words)]
        distinct, top = np.zeros(n_texts), np.zeros(n_texts)
        for i, a, b in zip(range(n_texts), first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                counts = np.unique(words[a:b], return_counts=True)[1]
                distinct[i], top[i] = len(counts), counts.max()
        columns = (
            np.log1p(n), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), per_word(length > 20), per_word(same), per_word(two),
            # a text has fewer new words the longer it is: the distance from the usual n ** 0.9
            distinct / some**0.9, top / some, sums["symbol"] / size * 10, per_word(_CLASS["symbol"][last]),
            per_word((length == 1) & (_CLASS["symbol"][last] > 0)), sums["shout"] / some, sums["upper"] / size * 10, sums["digit"] / size * 10, sums["high"] / size * 10,
            sums["stop"] / some * 10, sums["comma"] / some * 10, np.log1p(n / (sums["line"] + 1)),
        )
        x[have] = np.column_stack(columns)[have]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        offsets = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
        yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["doc_id", "x"])


@dataclass
class Ranking:
    """Weights of standardised features; ``shift`` and ``scale`` take the raw score to the logit of the final one."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    shift: float = 0.0
    scale: float = 0.0
    quantile: float | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        # row by row the same sum whatever the batch, unlike a matrix product
        return (self.standard(x) * self.weights).sum(axis=1)

    def score(self, raw: np.ndarray) -> np.ndarray:
        final = 1 / (1 + np.exp(-np.clip((raw - self.shift) * self.scale + np.log(CUT / (1 - CUT)), -40, 40)))
        return np.where(raw == self.shift, CUT, final)


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 1) -> Ranking:
    """Weights that minimise the mean logistic loss over ``pairs`` random pairs, by Newton's method, and the threshold."""
    every = np.concatenate((good, bad))
    rank = Ranking(every.mean(axis=0), every.std(axis=0) + 1e-9, np.zeros(every.shape[1]))
    draw = np.random.default_rng(seed)
    g, b = (np.clip((x - rank.mean) / rank.sd, -8, 8) for x in (good, bad))
    i = np.arange(max(min(pairs, len(g) * len(b)), 1))
    d = g[i % len(g)] - b[draw.integers(len(b), size=len(i))]
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ rank.weights, -30, 30)))  # chance that the bad text wins
        gradient = -(d.T @ p) / len(d) + ridge * rank.weights
        hessian = (d.T * (p * (1 - p))) @ d / len(d) + ridge * np.eye(d.shape[1])
        step = np.linalg.solve(hessian, gradient)
        rank.weights = rank.weights - step
        if np.abs(step).max() < 1e-6:
            break
    up, down = rank.raw(good), rank.raw(bad)
    scores = np.sort(np.concatenate((up, down)))
    level = np.linspace(0, 1, 1001)
    cuts = np.quantile(scores, level)
    right = np.searchsorted(np.sort(down), cuts, side="left") + len(up) - np.searchsorted(np.sort(up), cuts, side="left")
    best = np.flatnonzero(right == right.max())
    middle = best[len(best) // 2]
    rank.quantile, rank.shift = float(level[middle]), float(cuts[middle])
    rank.scale = 1.0
    return rank


_POINTS = (1 - np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)) / 2
_BASIS = np.linalg.inv(np.polynomial.chebyshev.chebvander(2 * _POINTS - 1, NODES - 1))
_F = len(FEATURES)
#: Where the hats' sums begin, and what keeps the numbers of units positive.
_SECOND, _ZERO = 1 << 48, 1 << 24


def _totals(rows: DataFrame, sums) -> tuple[np.ndarray, np.ndarray]:
    """(places, totals): what ``sums`` finds for parts of ``rows`` (quality, x), as {place: array}, added up place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        held, n = [], 0

        def add() -> None:
            good = np.concatenate([b.column("quality").to_numpy() for b in held]) == 1
            x = np.concatenate([b.column("x").flatten().to_numpy() for b in held]).reshape(len(good), _F)
            for at, v in sums(good, x).items():
                found[at] = found[at] + v if at in found else v

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                add()
                held, n = [], 0
        if n:
            add()
        if found:
            places = np.concatenate([at + np.arange(v.size) for at, v in found.items()])
            yield pa.record_batch([pa.array(places), pa.array(np.concatenate([v.ravel() for v in found.values()]).astype(np.float64))], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return got["i"].to_numpy(np.int64), got["v"].to_numpy(float)


def _spread(rank: Ranking, good: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
    """Numbers and features of the rows, by class and point of the score; with squares, by class and hat."""
    z, s, out = rank.standard(x), rank.raw(x), {}
    one = np.column_stack((np.ones(len(z)), z))
    unit, hat = np.floor(s).astype(np.int64), np.floor(s * HATS).astype(np.int64)
    width = 1 + _F + _F * _F
    for kind in (0, 1):
        own = np.flatnonzero(good == bool(kind))
        for u in np.unique(unit[own]):
            i = own[unit[own] == u]
            near = np.polynomial.chebyshev.chebvander(2 * (s[i] - u) - 1, NODES - 1) @ _BASIS
            out[((kind * 2 * _ZERO + int(u) + _ZERO) * NODES) * (1 + _F)] = near.T @ one[i]
        for h in np.unique(hat[own]):
            i = own[hat[own] == h]
            right = s[i] * HATS - h
            for step, w in ((0, 1 - right), (1, right)):
                at = _SECOND + (kind * 2 * _ZERO + int(h) + step + _ZERO) * width
                v = np.concatenate((w @ one[i], ((z[i].T * w) @ z[i]).ravel()))
                out[at] = out[at] + v if at in out else v
    return out


def _points(places: np.ndarray, totals: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, sums) of the points of the bad and of the good."""
    number, sums = places[:: 1 + _F] // (1 + _F), totals.reshape(-1, 1 + _F)
    unit, point = np.divmod(number, NODES)
    kind = unit // (2 * _ZERO)
    at = unit - kind * 2 * _ZERO - _ZERO + _POINTS[point]
    return [(at[kind == k], sums[kind == k]) for k in (0, 1)]


def _hats(places: np.ndarray, totals: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, sums) of the hats of the bad and of the good."""
    width = 1 + _F + _F * _F
    number, sums = places[::width] // width, totals.reshape(-1, width)
    kind = number // (2 * _ZERO)
    at = (number - kind * 2 * _ZERO - _ZERO) / HATS
    return [(at[kind == k], sums[kind == k]) for k in (0, 1)]


def _step(rank: Ranking, rows: DataFrame, n_pairs: float, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss over all pairs, its gradient, and nearly its matrix of second derivatives (never indefinite), from one
    pass over the rows."""
    places, totals = _totals(rows, lambda good, x: _spread(rank, good, x))
    first = places < _SECOND
    (at_b, bad), (at_g, good) = _points(places[first], totals[first])
    loss, gradient = 0.0, np.zeros(_F)
    hold = np.zeros(len(at_b))
    for i in range(0, len(at_g), 512):
        apart = np.clip(at_g[i : i + 512, None] - at_b, -700, 700)
        lost = 1 / (1 + np.exp(apart))  # chance that the bad text wins
        own = good[i : i + 512]
        loss += float(own[:, 0] @ np.logaddexp(0, -apart) @ bad[:, 0])
        gradient -= (lost @ bad[:, 0]) @ own[:, 1:]
        hold += own[:, 0] @ lost
    gradient += hold @ bad[:, 1:]
    (at_b, bad), (at_g, good) = _hats(places[~first] - _SECOND, totals[~first])
    p = 1 / (1 + np.exp(np.clip(at_g[:, None] - at_b, -700, 700)))
    p *= 1 - p
    hessian = np.tensordot(p @ bad[:, 0], good[:, 1 + _F :].reshape(-1, _F, _F), 1) + np.tensordot(good[:, 0] @ p, bad[:, 1 + _F :].reshape(-1, _F, _F), 1)
    cross = good[:, 1 : 1 + _F].T @ p @ bad[:, 1 : 1 + _F]
    hessian = (hessian - cross - cross.T) / n_pairs + ridge * np.eye(_F)
    return loss / n_pairs + ridge / 2 * float(rank.weights @ rank.weights), gradient / n_pairs + ridge * rank.weights, hessian


def all_pairs(rows: DataFrame, n_good: int, n_bad: int, ridge: float = 1e-3) -> Ranking:
    """The ranking by all pairs of a good and a bad one of ``rows`` (quality, x), a pass over the rows for each of Newton's steps."""
    n = n_good + n_bad
    mean = np.round(_totals(rows, lambda good, x: {0: x.sum(axis=0)})[1] / n, 12)
    sd = np.round(np.sqrt(_totals(rows, lambda good, x: {0: ((x - mean) ** 2).sum(axis=0)})[1] / n), 12) + 1e-9
    rank, n_pairs = Ranking(mean, sd, np.zeros(_F)), float(n_good) * n_bad
    loss, gradient, hessian = _step(rank, rows, n_pairs, ridge)
    for _ in range(60):
        step = np.linalg.solve(hessian, gradient)
        if np.abs(step).max() < 1e-7:
            break
        before = rank.weights
        for halved in range(20):
            rank.weights = before - step / 2**halved
            next_loss, gradient, hessian = _step(rank, rows, n_pairs, ridge)
            if next_loss <= loss + 1e-10:
                break
        loss = next_loss
    # sums of floats depend on their order in the last digits
    rank.weights = np.round(rank.weights, 9)
    rank.shift, rank.quantile = best_cut(rows, rank, n_good, n_bad)
    rank.scale = 1.0
    return rank


def best_cut(rows: DataFrame, rank: Ranking, n_good: int, n_bad: int) -> tuple[float, float]:
    """(cut, share of scores below it): a cut that judges the most rows rightly, of all cuts at whole UNITs.

    Scores are counted by coarse steps, then those steps by finer ones within which a better cut may lie.
    """

    def counts(shift: int, parents: set[int] | None):
        def sums(good: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
            u = np.floor(rank.raw(x) / UNIT).astype(np.int64)
            if parents is not None:
                some = np.isin(u >> (shift + 10), list(parents))
                u, good = u[some], good[some]
            step, own = np.unique(u >> shift, return_inverse=True)
            both = np.column_stack([np.bincount(own, weights=w, minlength=len(step)) for w in (good, ~good)])
            return {int(c) * 2: v for c, v in zip(step, both, strict=True)}

        places, totals = _totals(rows, sums)
        return (places[::2] // 2).tolist(), totals.reshape(-1, 2).astype(np.int64)

    most, cuts, known = -1, [], {None: (0, 0)}
    parents = None
    for shift in (20, 10, 0):
        steps, n = counts(shift, parents)
        begin, better, at, parent = {}, set(), (0, 0), None
        for c, (up, down) in zip(steps, n.tolist(), strict=True):
            if parents is not None and c >> 10 != parent:
                parent = c >> 10
                at = known[parent]
            begin[c] = at
            right = n_good - at[0] + at[1]
            if right > most:
                most, cuts = right, []
            if right == most:
                cuts.append((c << shift, at))
            at = (at[0] + up, at[1] + down)
        if parents is None and (right := n_good - at[0] + at[1]) >= most:
            cuts = [*cuts, ((steps[-1] + 1) << shift, at)] if right == most else [((steps[-1] + 1) << shift, at)]
            most = right
        for c, (_, down) in zip(steps, n.tolist(), strict=True):
            if n_good - begin[c][0] + begin[c][1] + down > most:
                better.add(c)
        if not better:
            break
        parents, known = better, begin
    cut, (up, down) = sorted(set(cuts))[len(set(cuts)) // 2]
    return cut * UNIT, (up + down) / (n_good + n_bad)


def fit(featured: DataFrame, labels: DataFrame, train: Column, scratch: Scratch) -> Ranking:
    """The ranking learned from all labelled rows of ``featured`` (doc_id, x) of which ``train`` holds.

    ``labels`` has doc_id and quality (0 or 1; other values and rows without doc_id are passed over; of a repeated doc_id
    the largest label counts, and of its texts the one with the smallest features).  Without labels of both kinds every text scores ``CUT``.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(train).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    rows = scratch.write(featured.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")), "labelled")
    n = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Ranking(np.zeros(_F), np.ones(_F), np.zeros(_F))
    if n[0] * n[1] <= PAIRS:
        few = rows.orderBy("doc_id").select("quality", "x").toPandas()
        x, good = np.stack(few.x.to_list()), few.quality.to_numpy() == 1
        return bradley_terry(x[good], x[~good])
    return all_pairs(rows.select("quality", "x").coalesce(-(-(n[0] + n[1]) // TASK)), n[1], n[0])


def score(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, raw, score, predicted) for each row of ``docs`` (doc_id, text; other columns ignored).

    raw is the Bradley-Terry score, score lies between 0 and 1, predicted is 1 from ``CUT`` on.  A null text counts as an
    empty one, and a text without words has the features 0.  Repeated rows score equally; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "quality")
    featured = scratch.write(texts(docs).mapInArrow(_featured, "doc_id long, x array<double>"), "features")
    shared = spark.sparkContext.broadcast(fit(featured, labels, train, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank: Ranking = shared.value
            raw = rank.raw(np.array(batch.column("x").flatten()).reshape(-1, len(FEATURES)))
            final = rank.score(raw)
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw), pa.array(final), pa.array((final >= CUT).astype(np.int32))], names=["doc_id", "raw", "score", "predicted"])

    return featured.mapInArrow(run, "doc_id long, raw double, score double, predicted int")
