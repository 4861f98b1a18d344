"""Spatially smoothed deconvolution against a dense solver, and plain NNLS at penalty 0."""

import numpy as np
import pytest

from cellweave.errors import IncompatibleDataError
from cellweave.operators import deconvolution

SIDE, TYPES, GENES = 10, 3, 20


def data(spark):
    rng = np.random.default_rng(8)
    a = rng.gamma(1.0, 2.0, (GENES, TYPES))
    x, y = np.divmod(np.arange(SIDE * SIDE), SIDE)
    b = np.stack([x / SIDE, 1 - x / SIDE, (y > 5) * 0.5], axis=1)
    counts = np.round(np.maximum(0, b @ a.T * 3 + rng.normal(0, 1.5, (SIDE * SIDE, GENES))), 3)
    counts[7] = 0
    counts[7, 0] = 1.0
    edges = [(i, i + 1) for i in range(SIDE * SIDE) if i % SIDE < SIDE - 1] + [(i + SIDE, i) for i in range(SIDE * (SIDE - 1))]
    rows = spark.createDataFrame([(i, g, float(counts[i, g])) for i in range(SIDE * SIDE) for g in range(GENES) if counts[i, g]], "obs_id long, gene_id long, value double")
    profiles = spark.createDataFrame([(f"t{k}", g, float(a[g, k])) for k in range(TYPES) for g in range(GENES)], "cell_type string, gene_id long, value double")
    graph = spark.createDataFrame([*edges, *[(j, i) for i, j in edges[:40]], (3, 3), (4, 5000)], "src long, dst long")
    return a, counts, edges, rows, profiles, graph


def dense(a, y, edges, penalty):
    """Coordinate descent over all spots and types of the whole problem, to the end."""
    n, g, h = len(y), a.T @ a, y @ a
    near = [[] for _ in range(n)]
    for i, j in edges:
        near[i].append(j)
        near[j].append(i)
    b = np.zeros((n, TYPES))
    for _ in range(20_000):
        before = b.copy()
        for i in range(n):
            for k in range(TYPES):
                pull = penalty * b[near[i], k].sum()
                b[i, k] = max(0.0, (h[i, k] - b[i] @ g[:, k] + g[k, k] * b[i, k] + pull) / (g[k, k] + penalty * len(near[i])))
        if np.abs(b - before).max() < 1e-12:
            return b
    raise AssertionError


@pytest.mark.parametrize("penalty", [2.0, 60.0])
def test_equal_to_a_dense_solver(spark, penalty):
    a, y, edges, rows, profiles, graph = data(spark)
    got = {r["obs_id"]: r["b"] for r in deconvolution.smooth_abundances(rows, profiles, graph, penalty, 10).collect()}
    want = dense(a, y, edges, penalty)
    assert len(got) == SIDE * SIDE
    assert max(np.abs(np.array(got[i]) - want[i]).max() for i in got) < 1e-5 * want.max()


def test_penalty_zero_is_nnls_and_rows_sum_to_one(spark):
    a, y, edges, rows, profiles, graph = data(spark)
    want = {(r["obs_id"], r["cell_type"]): r["proportion"] for r in deconvolution.proportions(rows, profiles, 10).collect()}
    got = {(r["obs_id"], r["cell_type"]): r["proportion"] for r in deconvolution.smooth_proportions(rows, profiles, graph, 0.0, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert all(abs(sum(got[i, f"t{k}"] for k in range(TYPES)) - 1) < 1e-9 for i in range(SIDE * SIDE))
    with pytest.raises(IncompatibleDataError):
        deconvolution.smooth_proportions(rows, profiles, graph, 1.0)
    with pytest.raises(IncompatibleDataError):
        deconvolution.smooth_proportions(rows, profiles, graph, -1.0, 10)
