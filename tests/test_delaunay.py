"""Delaunay triangulation: one tile and many against every triangle's empty circle."""

import numpy as np
import pytest

from cellweave.operators import delaunay


def brute_edges(xy):
    """Edges some circle through whose ends is empty: bounds of the circle's centre along the bisector, from every other point."""
    out = set()
    for a in range(len(xy)):
        for b in range(a + 1, len(xy)):
            m, d = (xy[a] + xy[b]) / 2, xy[b] - xy[a]
            rest = np.delete(np.arange(len(xy)), [a, b])
            v = xy[rest] - m
            s, q = v @ np.array([-d[1], d[0]]), (v * v).sum(axis=1) - d @ d / 4
            if max((q[s < 0] / (2 * s[s < 0])), default=-np.inf) < min((q[s > 0] / (2 * s[s > 0])), default=np.inf):
                out.add((a, b))
    return out


def points_of(name):
    rng = np.random.default_rng(7)
    if name == "even":
        return rng.random((220, 2))
    if name == "clumps":  # far apart, with holes between
        return np.concatenate([rng.normal(c, 0.02, (60, 2)) for c in ((0, 0), (5, 1), (1, 6))] + [rng.random((6, 2)) * 6])
    if name == "few":
        return np.concatenate([rng.random((70, 2)), rng.random((20, 2)) * 0.1 + [3, 2]])
    return np.stack([np.cos(t := np.sort(rng.random(90) * 6.28)), np.sin(t)], axis=1) * (1 + 1e-3 * rng.random((90, 1)))  # "ring"


@pytest.mark.parametrize("name", ["even", "clumps", "ring"])
def test_in_one_tile(name):
    xy = points_of(name)
    corners, _ = delaunay.triangulate(xy[:, 0], xy[:, 1])
    t = corners[corners[:, 2] >= 0]
    got = {tuple(sorted(e)) for a, b, c in t.tolist() for e in ((a, b), (b, c), (a, c))}
    assert got == brute_edges(xy)


@pytest.mark.parametrize("name", ["few"])
def test_tiles_equal_every_pair_tried(spark, name):
    xy = points_of(name)
    df = spark.createDataFrame([(i, float(x), float(y), 1) for i, (x, y) in enumerate(xy)], "obs_id long, x double, y double, d int")
    got = {(r["src"], r["dst"]) for r in delaunay.delaunay_edges(df, tile=9).collect()}
    assert got == brute_edges(xy)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0), ("d", 0.0, 0.0), ("e", nan, 0.0), ("f", None, 1.0), ("g", inf, 1.0)]
    df = spark.createDataFrame(rows, "obs_id string, x double, y double")
    assert sorted((r["src"], r["dst"], round(r["d"], 6)) for r in delaunay.delaunay_edges(df).collect()) == [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.414214)]
    assert delaunay.delaunay_edges(df.where("obs_id < 'c'")).count() == 0
    lattice = spark.range(100).selectExpr("id as obs_id", "cast(id % 10 as double) as x", "cast(id div 10 as double) as y")
    edges = {(r["src"], r["dst"]) for r in delaunay.delaunay_edges(lattice).collect()}
    sides = {(i, i + 1) for i in range(100) if i % 10 < 9} | {(i, i + 10) for i in range(90)}
    assert sides <= edges and {b - a for a, b in edges - sides} == {9, 11} and len(edges - sides) == 81  # one diagonal for each square
