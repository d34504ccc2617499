"""Quality learned from all labelled rows and all pairs, against loops over the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


@pytest.mark.parametrize("apart", [0.2, 1.0])
def test_weights_and_cut_come_from_all_pairs(spark, tmp_path, monkeypatch, apart):
    monkeypatch.setattr(quality, "PAIRS", 1000)
    monkeypatch.setattr(quality, "TASK", 200)
    draw = np.random.default_rng(4)
    y = (draw.random(700) < 0.8).astype(int)
    x = draw.standard_normal((700, len(quality.FEATURES))) * np.linspace(0.1, 3, len(quality.FEATURES)) + np.outer(y, np.full(len(quality.FEATURES), apart) * (np.arange(len(quality.FEATURES)) % 3))
    x[:, 5] = x[:, 4] + 0.01 * x[:, 5]
    featured = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, quality int")
    scratch = quality.Scratch(spark, "t")
    rank = quality.fit(featured.repartition(3), labels, F.lit(True), scratch)
    assert np.allclose(rank.mean, x.mean(axis=0)) and np.allclose(rank.sd, x.std(axis=0))
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    gradient = -(d.T @ (1 / (1 + np.exp(d @ rank.weights)))) / len(d) + 1e-3 * rank.weights
    assert np.abs(gradient).max() < 1e-7
    raw = rank.raw(x)
    right = lambda cut: ((raw >= cut) == (y == 1)).sum()
    assert right(rank.shift) == max(right(cut) for cut in [*raw, raw.max() + 1])
    assert rank.quantile == pytest.approx((raw < rank.shift).mean())
    # the same however the table is split
    again = quality.fit(featured.repartition(5), labels, F.lit(True), scratch)
    assert again.weights.tolist() == rank.weights.tolist() and again.shift == rank.shift


def test_every_labelled_row_counts(spark, monkeypatch):
    """More rows than were once sampled; the last ones alone tell good from bad by the second feature."""
    n, f = 24_000, len(quality.FEATURES)
    rows = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", f"transform(sequence(1, {f}), i -> IF(i = 1, (id % 7) / 7D, IF(i = 2, (id % 2) * 1D, IF(i = 3, (id % 11) / 11D, 0D)))) AS x")
    rank = quality.fit(rows.select("doc_id", "x"), rows.select("doc_id", "quality"), F.lit(True), quality.Scratch(spark, "t"))
    x = np.array([[(i % 7) / 7, i % 2, (i % 11) / 11] for i in range(n)])
    assert np.allclose(rank.mean[:3], x.mean(axis=0), atol=1e-11)
    assert rank.quantile == 0.5 and rank.weights[1] > 1
