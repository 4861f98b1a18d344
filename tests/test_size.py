"""Operators whose cost once grew faster than their input, or that passed a table through the driver."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import stats
from cellweave.operators import deconvolution, delaunay, leiden, neighbors, spatial


@pytest.fixture
def ring(spark, monkeypatch):
    """Thirty nodes in a ring, a pair apart and a lone node; no pair of nodes may be a row."""

    def refused(*_, **__):
        raise AssertionError("rows for pairs of nodes, or the graph in the driver")

    monkeypatch.setattr(neighbors, "hops", refused)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    edges = [(i, (i + 1) % 30) for i in range(30)] + [(30, 31)]
    return spark.createDataFrame(edges, "src long, dst long"), spark.range(33).withColumnRenamed("id", "obs_id")


def test_network_paths(ring):
    edges, nodes = ring
    whole = spatial.network_properties(edges.where("src < 30"), nodes.where("obs_id < 30")).first()
    assert (whole["components"], whole["diameter"], whole["radius"]) == (1, 15, 15)
    parts = spatial.network_properties(edges, nodes).first()
    assert (parts["components"], parts["diameter"]) == (3, None)


def test_betweenness(ring):
    got = {r["obs_id"]: r["betweenness"] for r in spatial.betweenness(*ring).collect()}
    # Between each of the 29 * 28 / 2 pairs of others of the ring lies a node or not: 196 of the paths pass it.
    assert len(got) == 33 and all(np.isclose(got[i], 2 * 98 / (32 * 31)) for i in range(30)) and got[30] == got[31] == got[32] == 0


def test_closeness(ring):
    got = {r["obs_id"]: r["closeness"] for r in spatial.closeness(*ring).collect()}
    assert len(got) == 33 and all(np.isclose(got[i], 29 / 225 * 29 / 32) for i in range(30)) and np.isclose(got[30], 1 / 32) and got[32] == 0


def test_yekutieli_is_linear(spark):
    p = np.random.default_rng(0).random(100_000) ** 3
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(p)), "p": p}))
    began = time.time()
    got = stats.adjust(df, method="by", order=("i",)).agg(F.sum("q")).first()[0]
    assert time.time() - began < 30
    m = np.arange(1, len(p) + 1)
    want = np.minimum(1, np.minimum.accumulate((np.sort(p) * len(p) * (1 / m).sum() / m)[::-1]))
    assert np.isclose(got, want.sum(), rtol=1e-12)
    h = spark.createDataFrame([(k,) for k in (1, 2, 63, 64, 65, 66, 1000)], "m long").select("m", stats.harmonic(F.col("m")).alias("h")).collect()
    assert all(np.isclose(r["h"], sum(1 / k for k in range(1, r["m"] + 1)), rtol=1e-14) for r in h)


def test_profiles_stay_off_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, share = rng.poisson(4, (120, 3)) + 1.0, rng.dirichlet(np.ones(3), 20)
    counts = spark.createDataFrame([(i, g, float(v)) for i, row in enumerate(share @ a.T) for g, v in enumerate(row)], "obs_id long, gene_id int, value double")
    profiles = spark.createDataFrame([(f"t{k}", g, float(a[g, k])) for g in range(120) for k in range(3)], "cell_type string, gene_id int, value double")
    monkeypatch.setattr(DataFrame, "toPandas", lambda _: pytest.fail("a table went to the driver"))
    got = {(r["obs_id"], r["cell_type"]): r["proportion"] for r in deconvolution.proportions(counts, profiles).collect()}
    assert len(got) == 60 and all(np.isclose(got[i, f"t{k}"], share[i, k], atol=1e-6) for i in range(20) for k in range(3))


def test_blocks_of_vectors_stay_few():
    assert [neighbors.vector_blocks(n * 64) for n in (500, 10_000, 100_000, 600_000)] == [1, 8, 8, 10]


@pytest.fixture
def no_broadcast(monkeypatch):
    """Every table that a round writes is planned without a copy by way of the driver."""

    def watch(module, allowed=()):
        plain = module.cut

        def cut(df):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("BroadcastExchange") <= sum(a in plan for a in allowed), plan
            return plain(df)

        monkeypatch.setattr(module, "cut", cut)

    return watch


def test_rounds_of_communities_and_components_broadcast_nothing(spark, no_broadcast):
    no_broadcast(leiden)
    no_broadcast(neighbors)
    edges = [(10 * g + i, 10 * g + j) for g in range(4) for i in range(6) for j in range(i)] + [(0, 10), (20, 30)]
    nodes = spark.createDataFrame(sorted({(x,) for e in edges for x in e}), "obs_id long")
    got = leiden.leiden(spark.createDataFrame(edges, "src long, dst long"), nodes, 1.0, in_task=5)
    assert len({r["obs_id"] // 10: r["cluster"] for r in got.collect()}) == 4
    assert "BroadcastHashJoin" not in neighbors.connected(spark.createDataFrame(edges, "src long, dst long"), nodes)._jdf.queryExecution().executedPlan().toString()


def test_triangles_broadcast_no_points(spark, no_broadcast):
    no_broadcast(delaunay, ("BroadcastNestedLoopJoin",))  # the eight extreme points
    xy = np.random.default_rng(1).random((60, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "obs_id long, x double, y double")
    edges = delaunay.delaunay_edges(df, tile=20)
    assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()
    assert edges.count() > 100
