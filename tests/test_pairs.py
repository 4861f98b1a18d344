"""Pair counts by blocks and chunks against every pair measured."""

import numpy as np
import pytest

from cellweave.operators import pairs


def points_of(n, seed, spread):
    rng = np.random.default_rng(seed)
    x, y = rng.random(n), rng.random(n) * 2
    if spread == "clumps":
        x[: n // 2], y[: n // 2] = rng.normal(0.3, 0.01, n // 2), rng.normal(0.5, 0.01, n // 2)
    if spread == "lattice":  # many distances at the edges of bins
        x, y = rng.integers(0, 12, n) / 8, rng.integers(0, 12, n) / 8
    return x, y, rng.integers(0, 3, n)


def brute(a, b, labels, top, bins, upper, same=False):
    dx, dy = a[0][:, None] - b[0][None], a[1][:, None] - b[1][None]
    d2 = dx * dx + dy * dy
    d = np.sqrt(d2)
    near = d <= top if upper else d2 <= top * top
    if same:
        near &= ~np.eye(len(d), dtype=bool)
    out = np.zeros((labels, labels, bins + 1), np.int64)
    i, j = np.nonzero(near)
    np.add.at(out, (a[2][i], b[2][j], pairs.bin_of(d[i, j], top / bins, bins, upper)), 1)
    return out


@pytest.mark.parametrize("spread", ["even", "clumps", "lattice"])
@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("bins", [1, 2, 50])
def test_histogram(spread, upper, bins):
    a, b = points_of(700, 1, spread), points_of(450, 2, spread)
    for top in (0.25, 1.0, 5.0):
        assert (pairs.histogram(a, b, 3, top, bins, upper) == brute(a, b, 3, top, bins, upper)).all()


def test_few_points_are_measured(monkeypatch):
    """Over 20,000 even points in five bins most pairs are counted without being measured."""
    measured, real = [], np.bincount
    monkeypatch.setattr(pairs.np, "bincount", lambda x, **k: measured.append(len(x)) or real(x, **k))
    a = points_of(20_000, 4, "even")
    assert pairs.histogram(a, a, 3, 3.0, 5, False).sum() == 20_000**2 and sum(measured) < 20_000**2 / 2


@pytest.mark.parametrize("upper", [False, True])
def test_blocks_equal_every_pair(spark, upper):
    x, y, label = points_of(400, 5, "clumps")
    group = np.arange(400) % 2
    rows = [(int(i), float(x[i]), float(y[i]), f"l{label[i]}", int(group[i])) for i in range(400)] + [(500, None, 1.0, "l0", 0), (501, float("nan"), 1.0, "l1", 0)]
    df = spark.createDataFrame(rows, "obs_id long, x double, y double, label string, g int")
    got = {(r["g"], r["label_a"], r["label_b"], r["bin"]): r["n"] for r in pairs.pair_counts(df, 0.7, 7, upper, ("g",), "label", block=40).collect()}
    want = {}
    for g in (0, 1):
        p = tuple(v[group == g] for v in (x, y, label))
        for i, j, k in zip(*np.nonzero(c := brute(p, p, 3, 0.7, 7, upper, True)), strict=True):
            want[g, f"l{i}", f"l{j}", k] = c[i, j, k]
    assert got == want
    assert pairs.pair_counts(df.where("false"), 0.7, 7, upper).count() == 0


@pytest.mark.parametrize("ties", [False, True])
def test_interaction_lines_find_the_quantile_by_counting(spark, monkeypatch, ties):
    from cellweave.operators import plotdata

    for name, small in (("BLOCK", 20), ("BINS", 5), ("SORTED", 3)):
        monkeypatch.setattr(plotdata, name, small)
    monkeypatch.setattr(plotdata.F, "percentile", None)  # holds every distance in one task
    rng = np.random.default_rng(6)
    xy = rng.integers(0, 6, (120, 2)).astype(float) if ties else rng.normal(size=(120, 2))
    value = rng.normal(size=(120, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "obs_id long, x double, y double")
    dense = spark.createDataFrame([(i, g, float(value[i, g])) for i in range(120) for g in (0, 1)], "obs_id long, gene_id int, value double")
    high = [np.flatnonzero(v > np.median(v[v > 0])) for v in value.T]
    d = {(i, j): float(np.hypot(*(xy[i] - xy[j]))) for i in high[0].tolist() for j in high[1].tolist() if i != j}
    bar = np.quantile(list(d.values()), 0.1) * (1 + 1e-12)
    got = {(r["src"], r["dst"]): r["d"] for r in plotdata.interaction_lines(points, dense, 0, 1, limit=None).collect()}
    assert got.keys() == {k for k, v in d.items() if v <= bar} and all(abs(got[k] - d[k]) < 1e-12 for k in got)
    shortest = plotdata.interaction_lines(points, dense, 0, 1, limit=5).collect()
    assert [(r["src"], r["dst"]) for r in shortest] == sorted(got, key=lambda k: (got[k], *k))[:5]
