"""Laws of group summaries against enumeration and permutations."""

from collections import Counter
from itertools import combinations, product
from math import comb

import numpy as np
import pytest

from cellweave.errors import ParameterError
from cellweave.operators import null_laws

CELLS, DRAWS = 240, 10_000
GROUPS = np.repeat([0, 1, 2], [120, 80, 40])


def matrix():
    """Six genes: skewed, sparse, whole numbers, dense; the second and third are high in groups 1 and 2."""
    rng = np.random.default_rng(5)
    x = np.stack([
        rng.gamma(0.7, 1.0, CELLS), rng.gamma(1.0, 1.0, CELLS) + 0.3 * (GROUPS == 1), rng.poisson(1.5, CELLS) + (GROUPS == 2),
        np.where(rng.random(CELLS) < 0.3, rng.gamma(2.0, 1.0, CELLS), 0), rng.lognormal(0, 0.5, CELLS), rng.poisson(0.4, CELLS),
    ], axis=1).astype(float)
    return np.round(x, 4)


def tables(spark, x):
    expr = spark.createDataFrame([(i, g, float(x[i, g])) for i, g in np.argwhere(x).tolist()] + [(3, None, 1.0), (None, 1, 2.0), (999, 1, 5.0), (4, 0, None)], "obs_id long, gene_id long, value double")
    groups = spark.createDataFrame([*enumerate(GROUPS.tolist()), (7777, None), (None, 1)], "obs_id long, group long")
    return expr, groups


def test_mean_of_few_draws_is_the_convolution():
    x, c = np.array([0.0, 1.0, 3.0]), np.array([5.0, 3.0, 2.0])
    v, m = null_laws.mean_law(x, c, 1.0, 4, finite=False)
    want = Counter()
    for draw in product(zip(x, c / 10, strict=True), repeat=4):
        want[sum(a for a, _ in draw) / 4] += np.prod([p for _, p in draw])
    got = {round(a, 9): p for a, p in zip(v, m, strict=True) if p > 1e-12}
    assert got.keys() == {round(a, 9) for a in want} and all(abs(got[round(a, 9)] - p) < 1e-12 for a, p in want.items())


def test_wide_windows_agree_with_narrow_ones(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.sort(np.round(rng.gamma(0.5, 1.0, 400), 3))
    c = np.ones(400)
    step = x.max() / 1024
    fine = null_laws.mean_law(x, c, step, 150)
    monkeypatch.setattr(null_laws, "LATTICE", 16)
    wide = null_laws.mean_law(x, c, step, 150)
    for (v, m) in (fine, wide):
        assert abs(v @ m - x.mean()) < 1e-6
        assert abs((v - x.mean()) ** 2 @ m / (x.var() / 150 * (400 - 150) / 399) - 1) < 2e-3
    for z in np.linspace(x.mean() - 0.2, x.mean() + 0.3, 9):
        assert abs(fine[1][fine[0] >= z].sum() - wide[1][wide[0] >= z].sum()) < 5e-3


@pytest.mark.parametrize("share", [0.5, 0.75, 0.9])
def test_quantiles_are_those_of_all_subsets(share):
    pool, n = np.array([0, 0, 0, 1, 1, 2, 4, 4, 7, 9.0]), 4
    values, counts = np.unique(pool, return_counts=True)
    v, m = null_laws.quantile_law(values, counts.astype(float), n, share)
    k = int(np.ceil(share * n))
    want = Counter(sorted(s)[k - 1] for s in combinations(pool, n))
    assert {float(a): round(p * comb(10, n), 6) for a, p in zip(v, m, strict=True)} == {float(a): float(c) for a, c in want.items()}
    v, m = null_laws.quantile_law(values, counts.astype(float), n, share, finite=False)
    want = Counter()
    for draw in product(zip(values, counts / 10, strict=True), repeat=n):
        want[sorted(a for a, _ in draw)[k - 1]] += np.prod([p for _, p in draw])
    assert np.allclose(m, [want[a] for a in v]) and len(v) == len(want)


def summarise(x, groups, share):
    if share is None:
        return np.stack([x[groups == g].mean(axis=0) for g in range(3)])
    return np.stack([np.sort(x[groups == g], axis=0)[int(np.ceil(share * (groups == g).sum() - 1e-9)) - 1] for g in range(3)])


@pytest.mark.parametrize("summary,how,score", [("mean", "min", "arithmetic"), ("mean", "average", "geometric"), ("q90", "min", "arithmetic"), ("q3", "average", "arithmetic")])
def test_agrees_with_permutations(spark, summary, how, score):
    """Ends are dealt independently: each gene has labels of its own, as the laws suppose."""
    x = matrix()
    expr, groups = tables(spark, x)
    pairs = spark.createDataFrame([("0", "1"), ("1", "c"), ("c", "4"), ("3", "5"), ("nowhere", "1"), (None, "1"), ("0", "1")], "ligand string, receptor string")
    members = spark.createDataFrame([("c", 2), ("c", 4), ("c", 4), ("broken", 2), ("broken", 77)], "complex string, gene_id long")
    rows = null_laws.analytic_p_values(expr, groups, pairs, members, summary, how, score, 0.1).collect()
    share = null_laws.SUMMARIES[summary]

    def ends(s):
        join = np.minimum if how == "min" else lambda a, b: (a + b) / 2
        return {str(g): s[..., g] for g in range(6)} | {"c": join(s[..., 2], s[..., 4])}

    def scores(a, b):
        return (a + b) / 2 if score == "arithmetic" else np.sqrt(a * b)

    seen = ends(summarise(x, GROUPS, share))
    rng = np.random.default_rng(11)

    def dealt(g):
        """(draw, group) summaries of a gene whose values are dealt to the cells at random."""
        v = rng.permuted(np.tile(x[:, g], (DRAWS, 1)), axis=1)
        parts = [v[:, GROUPS == k] for k in range(3)]
        if share is None:
            return np.stack([p.mean(axis=1) for p in parts], axis=1)
        return np.stack([np.sort(p, axis=1)[:, int(np.ceil(share * p.shape[1] - 1e-9)) - 1] for p in parts], axis=1)

    # The two sides of a pair, and c's members, get labels of their own.
    one, two = (ends(np.stack([dealt(g) for g in range(6)], axis=2)) for _ in range(2))
    names = [("0", "1"), ("1", "c"), ("c", "4"), ("3", "5")]
    shares = {}
    for a, b in names:
        for s in range(3):
            for t in range(3):
                bar = scores(seen[a][s], seen[b][t]) - 1e-9
                shares[s, t, a, b] = (scores(one[a][:, s], two[b][:, t]) >= bar).mean()
    got = {(r["source"], r["target"], r["ligand"], r["receptor"]): r for r in rows}
    assert len(rows) == 36 and got.keys() == shares.keys()
    for (s, t, a, b), r in got.items():
        assert abs(r["score"] - scores(seen[a][s], seen[b][t])) < 1e-3 * (share is not None) + 1e-9
        p = shares[s, t, a, b]
        # Whole numbers under a drawn-in law may miss part of an atom.
        assert abs(r["p"] - p) < 4.5 * np.sqrt(max(p * (1 - p), 1e-4) / DRAWS) + 0.012 * (share is None), (s, t, a, b, r["p"], p)


def test_planted_pair_is_found_and_settings_combine(spark):
    x = matrix()
    x[:, 0] += 3.0 * (GROUPS == 2)
    expr, groups = tables(spark, x)
    pairs = spark.createDataFrame([(0, 1), (4, 1), (3, 5)], "ligand long, receptor long")
    rows = {(r["source"], r["target"], r["ligand"]): r for r in null_laws.combined_p_values(expr, groups, pairs, summaries=("mean", "q3")).collect()}
    assert rows[2, 1, 0]["q"] < 1e-4 < 0.3 < rows[0, 0, 0]["p"]
    assert all(0 <= r["p"] <= 1 and r["p"] <= r["q"] + 1e-15 for r in rows.values()) and rows[2, 0, 0]["strength"] > rows[0, 0, 0]["strength"]


def test_defined_results(spark):
    expr, groups = tables(spark, matrix())
    pairs = spark.createDataFrame([(0, 1)], "ligand long, receptor long")
    assert null_laws.analytic_p_values(expr.limit(0), groups, pairs).count() == 0
    assert null_laws.analytic_p_values(expr, groups.limit(0), pairs).count() == 0
    assert null_laws.analytic_p_values(expr, groups, pairs.limit(0)).count() == 0
    one = null_laws.analytic_p_values(expr, groups.where("group is not null").withColumn("group", null_laws.F.lit(1)), pairs).collect()
    assert len(one) == 1 and one[0]["p"] == 1.0  # a single group is the whole
    for bad in ({"summary": "mode"}, {"score": "sum"}):
        with pytest.raises(ParameterError):
            null_laws.analytic_p_values(expr, groups, pairs, **bad)
    assert null_laws.logged(expr).agg({"value": "max"}).first()[0] == expr.agg({"value": "max"}).first()[0]


def test_tails_of_many_draws_take_little_memory():
    """A group of 60,000 in 600,000: the sums stop where terms are nothing, and are those of all terms."""
    import tracemalloc

    total, n, k = 600_000, 60_000, 30_000
    below = np.linspace(total * 0.46, total * 0.54, 300).round()
    tracemalloc.start()
    got = null_laws._below(k, below, total, n, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    j, f = np.arange(k, dtype=float), null_laws._log_factorial
    for b, p in list(zip(below, got, strict=True))[::30]:
        t = f(np.array([b])) - f(j) - f(b - j) + f(np.array([total - b])) - f(n - j) - f(total - b - n + j) - (f(np.array([float(total)])) - f(np.array([float(n)])) - f(np.array([float(total - n)])))
        assert np.isclose(p, np.exp(t).sum(), rtol=1e-8, atol=1e-12)


def test_values_are_counted_once_for_all_summaries(spark, monkeypatch):
    calls, plain = [], null_laws.all_laws
    monkeypatch.setattr(null_laws, "all_laws", lambda *a: calls.append(a[2]) or plain(*a))
    expr, groups = tables(spark, matrix())
    assert null_laws.combined_p_values(expr, groups, spark.createDataFrame([(0, 1)], "ligand long, receptor long")).count() == 9
    assert calls == [("mean", "median", "q3", "q90")]
