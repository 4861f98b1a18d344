"""Dispersion trend, shrinkage and the test that uses them."""

import math

import numpy as np
import pytest

from cellweave.operators import dispersion, markers


def test_trend_of_exact_points(spark):
    rows = [(s, float(m), a1 / m + a0) for s, a0, a1 in (("x", 0.1, 3.0), ("y", 0.02, 0.5)) for m in (2, 5, 10, 40, 100)]
    rows += [("x", 7.0, 1e6), ("x", 0.0, 1.0), ("x", 3.0, 1e-9), ("z", 4.0, 0.2)]
    df = spark.createDataFrame(rows, "s string, mean double, dispersion double")
    got = {r["s"]: (r["a0"], r["a1"]) for r in dispersion.trend(df, ("s",)).collect()}
    assert got.keys() == {"x", "y"}
    assert got["y"] == pytest.approx((0.02, 0.5), abs=1e-9)
    assert dispersion.trend(df.where("s = 'x' and dispersion < 100")).first().asDict() == pytest.approx({"a0": 0.1, "a1": 3.0}, abs=1e-9)
    falling = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 3.0)], "mean double, dispersion double")
    assert dispersion.trend(falling, rounds=1).first().asDict() == pytest.approx({"a0": (1 + 1 / 2 + 1 / 3) / (1 + 1 / 4 + 1 / 9), "a1": 0.0})


def test_trigamma(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0.5,), (1.0,), (10.0,)], "x double").select(dispersion.trigamma(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.pi**2 / 2, math.pi**2 / 6, 0.10516633568168575], abs=1e-9)


def test_best_dispersion_is_between_own_and_prior():
    rng = np.random.default_rng(2)
    mu = np.full(200, 30.0)
    y = rng.negative_binomial(1 / 0.4, 1 / (1 + 0.4 * mu)).astype(float)
    design = np.column_stack([np.ones(200), np.arange(200) % 2])
    own = dispersion.best_dispersion(y, mu, design)
    assert own == pytest.approx(0.4, rel=0.25)
    grid = np.exp(np.linspace(math.log(own) - 0.5, math.log(own) + 0.5, 101))
    assert dispersion._likelihood(y, mu, own, design) >= max(dispersion._likelihood(y, mu, a, design) for a in grid) - 1e-6
    near, free = dispersion.best_dispersion(y[:6], mu[:6], design[:6], 0.05, 1e-4), dispersion.best_dispersion(y[:6], mu[:6], design[:6], 0.05, 1e6)
    assert near == pytest.approx(0.05, rel=0.05) and free == pytest.approx(dispersion.best_dispersion(y[:6], mu[:6], design[:6]), rel=0.01)


def bulk_of(spark, genes=60, samples=8, changed=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for stratum in ("s", "t"):
        for g in range(genes):
            mean = 20 * 1.1**g
            alpha = 2 / mean + 0.05
            for k in range(samples):
                mu = mean * (4 if g < changed and k < samples // 2 and stratum == "s" else 1)
                rows.append((stratum, f"{stratum}{k}", "ab"[k >= samples // 2], g, float(rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mu)))))
    return spark.createDataFrame(rows, "stratum string, sample string, condition string, gene_id long, value double")


def test_wald_by_stratum_is_one_job_and_equals_each_alone(spark):
    bulk = bulk_of(spark)
    factors = bulk.select("stratum", "sample").distinct().selectExpr("stratum", "sample", "1.0D as size_factor")
    both = {(r["stratum"], r["gene_id"]): r for r in dispersion.wald(bulk, factors, "a", "b", ("stratum",)).collect()}
    alone = {r["gene_id"]: r for r in markers.negative_binomial_wald(bulk.where("stratum = 's'"), factors.where("stratum = 's'").drop("stratum"), "a", "b").collect()}
    for g, r in alone.items():
        assert (both["s", g]["p"], both["s", g]["dispersion"]) == pytest.approx((r["p"], r["dispersion"]), rel=1e-6)
    assert all(alone[g]["q"] < 0.05 and alone[g]["log2fc"] == pytest.approx(2, abs=1.0) for g in range(6))
    p = np.array([both["t", g]["p"] for g in range(60)])
    assert (p < 0.05).mean() < 0.2 and 0.3 < np.median(p) < 0.75
    truth = np.array([2 / (20 * 1.1**g) + 0.05 for g in range(60)])
    loose = {r["gene_id"]: r["dispersion"] for r in dispersion.wald(bulk.where("stratum = 't'").drop("stratum"), factors.where("stratum = 't'").drop("stratum"), "a", "b", shrink=False).collect()}
    error = lambda d: np.abs(np.log(np.array(d) / truth)).mean()
    assert error([both["t", g]["dispersion"] for g in range(60)]) < 0.8 * error([loose[g] for g in range(60)])


def test_genes_are_fitted_side_by_side(spark):
    rng = np.random.default_rng(5)
    y = rng.negative_binomial(2, 2 / (2 + 10 ** rng.uniform(0, 4, (300, 1))), (300, 9)).astype(float)
    s, first = rng.uniform(0.5, 2, y.shape), np.tile((np.arange(9) < 4).astype(float), (300, 1))
    y = y[keep := y.sum(axis=1) > 0]
    s, first = s[keep], first[keep]
    beta, mu, spread = dispersion.fitted_means(y, s, first, np.full(len(y), 0.2))
    got = dispersion.best_dispersions(y, mu, first)
    for k in range(0, len(y), 40):
        alone = dispersion.fitted_means(y[k : k + 1], s[k : k + 1], first[k : k + 1], np.array([0.2]))
        assert (beta[k], spread[k]) == pytest.approx((alone[0][0], alone[2][0]))
        assert got[k] == pytest.approx(dispersion.best_dispersion(y[k], mu[k], np.column_stack([np.ones(9), first[k]])), rel=1e-4)
    r = np.array([[0.3, 2.0, 1e4]])
    v = np.array([[7.0, 40.0, 3.0]])
    assert dispersion._rising(v, r)[0] == pytest.approx([math.lgamma(a + b) - math.lgamma(b) for a, b in zip(v[0], r[0])], rel=1e-8)
    bulk = bulk_of(spark, genes=5)
    factors = bulk.select("stratum", "sample").distinct().selectExpr("stratum", "sample", "1.0D as size_factor")
    genes, sets = dispersion._packed(bulk.where("value > 0"), factors, "a", "b", ("stratum",))
    assert genes.count() == 10 and sets.count() == 2


def test_strata_of_unlike_samples_share_a_batch(spark):
    bulk = bulk_of(spark, genes=12).where("not (stratum = 't' and sample in ('t0', 't7'))").repartition(1)
    factors = bulk.select("stratum", "sample").distinct().selectExpr("stratum", "sample", "1.0D + length(sample) / 10D as size_factor")
    genes, sets = dispersion._packed(bulk, factors, "a", "b", ("stratum",))
    rows = dispersion._beside(genes, sets, ("stratum",)).coalesce(1)
    got = {(r["stratum"], r["gene_id"]): r["dispersion"] for r in dispersion.dispersions(rows, ("stratum",)).collect()}
    assert len(got) == 24
    y = {(r["stratum"], r["gene_id"], r["sample"]): r["value"] for r in bulk.collect()}
    for (stratum, g), alpha in got.items():
        names = sorted({n for s, _, n in y if s == stratum})
        v, s = np.array([[y[stratum, g, n] for n in names]]), np.full((1, len(names)), 1.2)
        first = np.array([[float(int(n[1:]) < 4) for n in names]])
        mu = dispersion.fitted_means(v, s, first, dispersion.rough_dispersions(v / s, s, first))[1]
        assert alpha == pytest.approx(dispersion.best_dispersions(v, mu, first)[0], rel=1e-3)
