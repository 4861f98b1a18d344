"""Seeded factorisation: the error falls, planted factors and mixtures are found."""

import numpy as np
import pytest

from cellweave.errors import IncompatibleDataError
from cellweave.operators import factors

TYPES, GENES, CELLS, SPOTS = 3, 30, 90, 25


def long(spark, x):
    return spark.createDataFrame([(i, g, float(x[i, g])) for i, g in np.argwhere(x).tolist()], "obs_id long, gene_id long, value double")


def planted():
    rng = np.random.default_rng(3)
    w = rng.gamma(0.6, 2.0, (TYPES, GENES)) * (np.arange(GENES) % TYPES == np.arange(TYPES)[:, None]) + 0.2 * rng.random((TYPES, GENES))
    kind = np.arange(CELLS) % TYPES
    cells = np.maximum(0, w[kind] * rng.uniform(0.8, 1.2, (CELLS, 1)) + rng.normal(0, 0.05, (CELLS, GENES)))
    mix = rng.dirichlet(np.full(TYPES, 0.7), SPOTS)
    return w, kind, cells, mix, mix @ w * 5


def test_error_falls_to_the_planted_factors(spark):
    rng = np.random.default_rng(6)
    w, *_ = planted()
    h = rng.gamma(0.5, 1.0, (CELLS, TYPES))
    x = h @ w
    start = spark.createDataFrame([(g, [float(v) for v in w[:, g] * rng.uniform(0.5, 1.5, TYPES) + 0.3]) for g in range(GENES)], "gene_id long, f array<double>")
    fit = factors.factorise(long(spark, x), start, rounds=8, settled=0.0)
    assert len(fit.errors) >= 2 and all(b <= a + 1e-9 * (x**2).sum() for a, b in zip(fit.errors, fit.errors[1:], strict=False))
    a = np.zeros((CELLS, TYPES))
    b = np.zeros((TYPES, GENES))
    for r in fit.obs.collect():
        a[r["obs_id"]] = r["f"]
    for r in fit.genes.collect():
        b[:, r["gene_id"]] = r["f"]
    assert a.min() >= 0 and b.min() >= 0
    error = ((x - a @ b) ** 2).sum()
    assert abs(error - fit.errors[-1]) < 1e-6 * (x**2).sum() and error < 2e-3 * (x**2).sum()
    assert min(np.corrcoef(b[k], w[k])[0, 1] for k in range(TYPES)) > 0.95


def test_planted_mixtures(spark):
    w, kind, cells, mix, spots = planted()
    types = spark.createDataFrame([(i, f"t{k}") for i, k in enumerate(kind.tolist())] + [(None, "t0"), (5000, None)], "obs_id long, cell_type string")
    counts = long(spark, spots).unionByName(spark.createDataFrame([(900, 555, 1.0), (900, None, 2.0)], "obs_id long, gene_id long, value double"))
    rows = factors.factor_proportions(counts, long(spark, cells), types, least_genes=10, rounds=4).collect()
    got = {(r["obs_id"], r["cell_type"]): r["proportion"] for r in rows}
    assert len(got) == len(rows) == (SPOTS + 1) * TYPES and all(got[900, f"t{k}"] == 0 for k in range(TYPES))
    assert max(abs(got[i, f"t{k}"] - mix[i, k]) for i in range(SPOTS) for k in range(TYPES)) < 0.05
    with pytest.raises(IncompatibleDataError):
        factors.factor_proportions(counts, long(spark, cells), types)
