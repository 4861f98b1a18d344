"""The marker mixture: planted types, a likelihood that never falls, and the bound on marked rates."""

import numpy as np
import pytest

from cellweave.errors import DataError
from cellweave.operators import marker_mixture


def planted(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    types, genes = 4, 24
    marks = np.array([[g % types == k for g in range(genes)] for k in range(types)])
    base = rng.uniform(0.5, 2.0, genes)
    kind = rng.choice(types, n, p=[0.55, 0.25, 0.15, 0.05])
    size = rng.uniform(0.5, 2.0, n)
    mu = size[:, None] * np.where(marks[kind], 5 * base, base)
    y = rng.negative_binomial(3, 3 / (3 + mu))
    rows = [(i, g, float(y[i, g])) for i in range(n) for g in range(genes) if y[i, g]]
    counts = spark.createDataFrame(rows, "obs_id long, gene_id long, value double").repartition(5)
    markers = spark.createDataFrame([(f"t{k}", g, 1) for k in range(types) for g in range(genes) if marks[k, g]] + [("t0", 1, -1), ("none", 99, 1), (None, 3, 1), ("t0", 0, 1)], "cell_type string, gene_id long, direction int")
    return counts, markers, kind


def test_planted_types_are_found(spark):
    counts, markers, kind = planted(spark)
    got = {r["obs_id"]: r for r in marker_mixture.assign(counts, markers).collect()}
    assert len(got) == counts.select("obs_id").distinct().count()
    assert np.mean([r["cell_type"] == f"t{kind[i]}" for i, r in got.items()]) > 0.93
    assert all(0.25 <= r["confidence"] <= 1 + 1e-12 for r in got.values())


def test_likelihood_never_falls_and_rates_are_raised(spark):
    counts, markers, kind = planted(spark, 150, 5)
    fit = marker_mixture.fit(counts, markers, rounds=25, tolerance=0.0)
    assert fit.types == ["t0", "t1", "t2", "t3"] and len(fit.genes) == 24
    assert len(fit.likelihoods) > 5 and np.diff(fit.likelihoods).min() >= -1e-7
    for g in range(24):
        base = {round(fit.rates[k, g], 12) for k in range(4) if g % 4 != k}
        assert len(base) == 1 and fit.rates[g % 4, g] >= marker_mixture.RAISE * base.pop() - 1e-9
    assert fit.weights.sum() == pytest.approx(1.0)
    with pytest.raises(DataError):
        marker_mixture.fit(counts, markers.where("cell_type = 'none'"))


def test_bounded_rates_are_the_best_ones():
    rng = np.random.default_rng(6)
    marks = np.array([[False], [False], [True], [True], [True]])
    for _ in range(20):
        y, s = rng.uniform(0, 5, (5, 1)), rng.uniform(0.5, 3, (5, 1))
        rates = marker_mixture._raised(y, s, marks)[:, 0]
        gain = lambda base, up: float((y[:2, 0] * np.log(base) - s[:2, 0] * base).sum() + (y[2:, 0] * np.log(up) - s[2:, 0] * up).sum())
        best = max(gain(b, np.maximum(2 * b, y[2:, 0] / s[2:, 0])) for b in np.geomspace(1e-3, 20, 4000))
        assert gain(rates[0], rates[2:]) >= best - 1e-9
