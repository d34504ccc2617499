"""Toxic passages by maximum-scoring segments of token log-odds.

Lexicon: the tokens of a word are its first 4, 5, ... 8 bytes and the whole word, lower-cased, letters only.
For each token, the log-odds between toxic and clean labelled texts is taken with a Dirichlet prior in proportion to the
token's pooled count (Monroe, Colaresi and Quinn, 2008), and lowered by 1.64 standard errors.  Occurrences give the odds
(n of them in one text count ``DAMP`` * log(1 + n / ``DAMP``), so that a text that repeats one word over and over doesn't
outweigh the others), texts give the error.  Tokens that stay above ``LEAST`` are kept, and a word has the
largest of its tokens' odds, or 0.

Scan: toxic passages are taken to hold a share ``mix`` of lexicon words, so a word of log-odds d scores
log(1 - mix + mix * exp(d)); other words score a little below 0.  All maximal scoring segments of a text are found in linear time
(Ruzzo and Tompa, 1999).

Calibration: by construction such scores have lambda = 1 in the extreme-value law of segment scores, E = K n exp(-S); K is
counted on clean texts that the lexicon hasn't seen.  A text's -log E, of its best segment, and the sum of its segments'
scores go through a logistic curve fitted on labelled texts that the lexicon hasn't seen either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, texts, tune
from .shingles import _BYTE, mix, powers, string_chunks

PREFIXES = (4, 5, 6, 7, 8)
#: At most so many labelled rows are learned from (those with the smallest hash of doc_id).
SAMPLE = 40_000
LEAST = 1.5
MIX = 0.01
#: The prior's weight, as a share of the counts.
PRIOR = 0.03
#: From about so many occurrences in a text on, more of them count less.
DAMP = 4

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWER = powers(_BASE, max(PREFIXES))


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length in bytes) of each run of letters, and the index of each text's first word and the total."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _LETTER[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:]))
    return starts, ends - starts + 1, np.searchsorted(starts, offsets)


def tokens(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words that have it, fingerprint) by token: each prefix of words longer than it, then the word itself."""
    if not len(starts):
        return
    h = np.zeros(len(starts), np.uint64)
    padded = np.concatenate((data, np.zeros(max(PREFIXES), np.uint8)))
    for k in range(max(PREFIXES) + 1):
        live = lengths > k
        if k in PREFIXES:
            at = np.flatnonzero(live)
            yield at, mix(h[at] + np.uint64(k))
        if k < max(PREFIXES):
            h[live] += _BYTE[padded[starts[live] + k]] * _POWER[k]
    # the whole word: bytes after it, up to the next one, count nothing
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    value = _BYTE[data[starts[0] :]] * powers(_BASE, int(spans.max()))[place]
    value[place >= np.repeat(lengths, spans)] = 0
    yield np.arange(len(starts)), mix(np.add.reduceat(value, starts - starts[0]) + np.uint64(64))


_COUNTS = "token long, toxic long, clean long, toxic_n long, clean_n long"


def _counts():
    """Of each token and each label, the texts that have it and its occurrences (damped, in thousandths); summed by chunk."""
    schema = pa.schema([(c, pa.int64()) for c in ("token", "toxic", "clean", "toxic_n", "clean_n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column("toxic").to_pylist(), dtype=np.int64) == 1
            for row, data, offsets in string_chunks(pc.utf8_lower(batch.column("text"))):
                starts, lengths, first = letter_words(data, offsets)
                if not len(starts):
                    continue
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                h, o = (np.concatenate(c) for c in zip(*((h, owner[at]) for at, h in tokens(data, starts, lengths)), strict=True))
                order = np.lexsort((o, h))
                h, o = h[order], o[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))[: len(h)])
                times = np.round(1000 * DAMP * np.log1p(np.diff(np.append(new, len(h))) / DAMP)).astype(np.int64)
                toxic = label[row + o[new]]
                values, at = np.unique(h[new], return_inverse=True)
                add = lambda w: pa.array(np.bincount(at, weights=w, minlength=len(values)).astype(np.int64))  # noqa: B023, E731
                yield pa.record_batch([pa.array(values.view(np.int64)), add(toxic), add(~toxic), add(toxic * times), add(~toxic * times)], schema=schema)

    return run


@dataclass
class Lexicon:
    """Sorted token fingerprints with their log-odds, and the calibration."""

    token: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mix: float = MIX
    k: float = 1.0
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def __post_init__(self):
        self.screen = np.zeros(1 << 16, dtype=bool)
        self.screen[self.token & np.uint64(0xFFFF)] = True

    def word_scores(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, score) of the words that have a token in the lexicon."""
        odds = np.zeros(len(starts))
        if len(self.token):
            for at, h in tokens(data, starts, lengths):
                some = np.flatnonzero(self.screen[h & np.uint64(0xFFFF)])
                place = np.minimum(np.searchsorted(self.token, h[some]), len(self.token) - 1)
                real = self.token[place] == h[some]
                word = at[some[real]]
                odds[word] = np.maximum(odds[word], self.odds[place[real]])
        hit = np.flatnonzero(odds)
        return hit, np.log(1 - self.mix + self.mix * np.exp(odds[hit]))

    def segments(self, hits: list[int], scores: list[float]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first word, last word, score) of a text whose other words score log(1 - mix).

        Each candidate knows the last one before it with a smaller sum to its left (Ruzzo and Tompa's linked list); links
        that a search has followed lie behind the new candidate's own, so all searches together take linear time.
        """
        gap = math.log(1 - self.mix)
        # each candidate: first word, last word, sum before it, sum with it, the candidate its search goes on with
        stack: list[tuple[int, int, float, float, int]] = []
        total, last = 0.0, -1
        for i, s in zip(hits, scores, strict=True):
            total += gap * (i - last - 1)
            last = i
            first, before, total = i, total, total + s
            if s <= 0:
                continue
            j = len(stack) - 1
            while j >= 0:
                if stack[j][2] >= before:
                    j = stack[j][4]
                elif stack[j][3] < total:
                    first, _, before, _, link = stack[j]
                    del stack[j:]
                    j = link
                else:
                    break
            stack.append((first, i, before, total, j))
        return [(a, b, right - left) for a, b, left, right, _ in stack]

    def minus_log_e(self, words: int, score: float) -> float:
        return max(0.0, score - math.log(max(self.k * words, 1e-300))) if score > 0 else 0.0

    def probability(self, x: float, total: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.curve[0] + self.curve[1] * x + self.curve[2] * total))))


_SCORED = "doc_id long, n_words long, best double, total double, x double, score double, segments array<struct<first:int,last:int,score:double,evalue:double>>"


def _scan(shared):
    segment = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("best", pa.float64()), ("total", pa.float64()), ("x", pa.float64()), ("score", pa.float64()), ("segments", pa.list_(segment))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for batch in batches:
            n_words, best, totals, xs, scores, found = [], [], [], [], [], []
            for _, data, offsets in string_chunks(pc.utf8_lower(batch.column("text"))):
                starts, lengths, first = letter_words(data, offsets)
                hit, s = lexicon.word_scores(data, starts, lengths)
                edges = np.searchsorted(hit, first)
                for a, b, lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    parts = lexicon.segments((hit[lo:hi] - a).tolist(), s[lo:hi].tolist())
                    top = max((p[2] for p in parts), default=0.0)
                    x = lexicon.minus_log_e(b - a, top)
                    n_words.append(b - a)
                    best.append(top)
                    totals.append(sum(p[2] for p in parts))
                    xs.append(x)
                    scores.append(lexicon.probability(x, totals[-1]))
                    found.append([{"first": p, "last": q, "score": t, "evalue": math.exp(-lexicon.minus_log_e(b - a, t))} for p, q, t in parts])
            columns = (pa.array(n_words, pa.int64()), *(pa.array(c, pa.float64()) for c in (best, totals, xs, scores)), pa.array(found, pa.list_(segment)))
            yield pa.record_batch([batch.column("doc_id"), *columns], schema=schema)

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method; the ridge holds the slopes when the classes are apart."""
    design = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(design.shape[1]), np.array([1e-6] + [ridge] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p) + 1e-9)) @ design + np.diag(penalty), design.T @ (p - y) + penalty * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, least: float = LEAST, mix_share: float = MIX, prior: float = PRIOR) -> Lexicon:
    """The lexicon and its calibration, learned from at most ``sample`` labelled rows of which ``train`` holds.

    ``labels`` has doc_id and toxic (0 or 1; others, and rows without doc_id, are passed over; of a repeated doc_id the
    largest label counts).  Two thirds of the rows make the lexicon, one third the calibration.  Without labels of both
    kinds the lexicon is empty, and every text scores the same.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(train).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    scratch = Scratch(spark, "toxicity")
    rows = scratch.write(texts(docs).join(chosen, "doc_id"), "labelled").select("doc_id", "text", "toxic")
    third = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(3)) == 0

    counts = rows.where(~third).mapInArrow(_counts(), _COUNTS).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_n", "clean_n")))
    counts = scratch.write(counts, "counts")
    n1, n0 = (float(v or 0) for v in counts.agg(F.sum("toxic_n"), F.sum("clean_n")).first())
    if not n1 or not n0:
        return Lexicon()
    own = (F.col("toxic_n") + F.col("clean_n")) * prior
    own_texts = (F.col("toxic") + F.col("clean")) * prior
    rate = lambda y, n: F.log((y + own) / (n + prior * (n1 + n0) - y - own))
    error = F.sqrt(1 / (F.col("toxic") + own_texts) + 1 / (F.col("clean") + own_texts))
    odds = rate(F.col("toxic_n"), n1) - rate(F.col("clean_n"), n0) - 1.64 * error
    # the lexicon comes from the bounded sample, so its size is bounded too
    found = counts.select("token", odds.alias("odds")).where(F.col("odds") >= least).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    lexicon = Lexicon(token[order], found["odds"].to_numpy(float)[order], mix_share)

    held = rows.where(third)
    seen = held.mapInArrow(_scan(spark.sparkContext.broadcast(lexicon)), _SCORED).join(held.select("doc_id", "toxic"), "doc_id").select("toxic", "n_words", "best", "total", F.size("segments").alias("n")).toPandas()
    clean = seen[seen.toxic == 0]
    lowest = math.log(1 - mix_share + mix_share * math.exp(float(lexicon.odds.min()))) if len(lexicon.token) else 0.0
    lexicon.k = (1.0 + float(clean.n.sum())) / (1.0 + float(clean.n_words.sum()) * math.exp(-lowest))
    x = np.array([lexicon.minus_log_e(n, s) for n, s in zip(seen.n_words, seen.best, strict=True)])
    if 0 < seen.toxic.sum() < len(seen):
        lexicon.curve = _logistic(np.column_stack((x, seen.total.to_numpy(float))), seen.toxic.to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, best (its best segment's score), total (all segments'), x
    (-log E), score (0 to 1) and segments (first and last word, score and E-value of each toxic passage).

    Null, empty and wordless texts have no segments and the lowest score.  Other columns are ignored; repeated rows score
    equally; texts of any length are scanned whole.
    """
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(lexicon)), _SCORED)
