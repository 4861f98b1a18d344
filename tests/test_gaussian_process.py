"""Gaussian-process test: the profile likelihood against dense covariance matrices, planted and null genes."""

import math

import numpy as np
import pytest

from cellweave.errors import DataError
from cellweave.operators import spatial_genes


def test_gain_equals_dense_likelihood():
    rng = np.random.default_rng(1)
    phi = rng.normal(size=(40, 6))
    phi -= phi.mean(axis=0)
    y = phi @ rng.normal(size=6) + rng.normal(size=40)
    y -= y.mean()
    s, v = np.linalg.eigh(phi.T @ phi)
    z2 = (v.T @ (phi.T @ y)) ** 2 / s
    gain, ratio = spatial_genes.variance_share(z2, s, y @ y - z2.sum(), 39)

    def likelihood(r):  # over the 39 dimensions beside the mean
        q = np.linalg.svd(np.ones((40, 1)))[0][:, 1:]
        cov = q.T @ (np.eye(40) + r * phi @ phi.T) @ q
        w = q.T @ y
        noise = w @ np.linalg.solve(cov, w) / 39
        return -0.5 * (39 * math.log(noise) + np.linalg.slogdet(cov)[1])

    assert gain == pytest.approx(likelihood(ratio) - likelihood(0.0), abs=1e-9)
    assert likelihood(ratio) >= max(likelihood(math.exp(t)) for t in np.linspace(-10, 6, 200)) - 1e-6


def test_planted_genes_and_noise(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((300, 2))
    rows = []
    for g in range(60):
        shape = {0: xy[:, 0] * 3, 1: np.sin(6 * xy[:, 1]) * 2, 2: 4 * np.exp(-((xy - 0.5) ** 2).sum(axis=1) * 20)}.get(g, np.zeros(300))
        rows += [(i, g, float(v)) for i, v in enumerate(np.maximum(0, shape + 1 + rng.normal(0, 0.7, 300))) if v]
    expr = spark.createDataFrame(rows, "obs_id long, gene_id long, value double").repartition(6)
    coords = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, None, 0.0)], "obs_id long, x double, y double")
    got = {r["gene_id"]: r for r in spatial_genes.gaussian_process(expr, coords, 3, 32).collect()}
    assert all(got[g]["q"] < 1e-6 and got[g]["share"] > 0.2 for g in range(3))
    null = np.array([got[g]["p"] for g in range(3, 60)])
    assert (null < 0.05).mean() <= 0.2 and (null < 0.001).mean() <= 0.02 and (null >= 0.25).mean() > 0.3
    with pytest.raises(DataError):
        spatial_genes.gaussian_process(expr, coords.where("obs_id < 2"))
