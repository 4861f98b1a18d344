"""Permutations are drawn in the tasks of their chunk: no plan holds a row for an observation and a permutation."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import communication, permutations, spatial

N, PERMS = 40, 53


def drawn(perm):
    return np.array(sorted(range(N), key=lambda i: (md5(f"42:{perm}:{i}".encode()).hexdigest(), i)))


@pytest.fixture(scope="module")
def graph(spark):
    e = [(i, (i + k) % N) for i in range(N) for k in (1, 2, 5)]
    return e, spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame([(i, i * i % 3) for i in range(N)], "obs_id long, label long")


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_is_that_of_the_hashes(spark):
    ids = spark.range(N).withColumnRenamed("id", "obs_id")
    got = {(r["perm"], r["obs_id"]): r["partner"] for r in spatial.permutation_order(ids, PERMS).collect()}
    assert got == {(p, i): int(drawn(p)[i]) for p in range(1, PERMS + 1) for i in range(N)}


def test_local_join_counts(graph):
    e, edges, labels = graph
    df = spatial.local_join_count_p(edges, labels, PERMS)
    assert "md5" not in planned(df)
    y = np.arange(N) ** 2 % 3
    near = [[b for a, b in e if a == i] for i in range(N)]
    for r in df.collect():
        i = r["obs_id"]
        above = sum((y[drawn(p)][near[i]] == y[i]).sum() >= (y[near[i]] == y[i]).sum() for p in range(1, PERMS + 1))
        assert r["p_sim"] == (above + 1) / (PERMS + 1)


def test_local_morans(graph):
    e, edges, labels = graph
    values = labels.select("obs_id", F.explode(F.array(F.struct(F.lit(1).alias("gene_id"), F.sin("obs_id").alias("value")), F.struct(F.lit(2).alias("gene_id"), F.cos("obs_id").alias("value")))).alias("s")).select("obs_id", "s.*")
    df = spatial.local_morans_p(edges, values, PERMS)
    assert "md5" not in planned(df)
    near = [[b for a, b in e if a == i] for i in range(N)]
    for r in df.collect():
        x = (np.sin if r["gene_id"] == 1 else np.cos)(np.arange(N))
        z, i = x - x.mean(), r["obs_id"]
        above = sum(z[drawn(p)][near[i]].mean() >= z[near[i]].mean() for p in range(1, PERMS + 1))
        assert np.isclose(r["p_sim"], (min(above, PERMS - above) + 1) / (PERMS + 1))


def test_pair_scores(spark, graph):
    _, _, labels = graph
    x = np.random.default_rng(3).random((N, 3))
    expr = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(N) for g in range(3)], "obs_id long, gene_id int, value double")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "ligand int, receptor int")
    df = communication.pair_p_values(expr, labels.withColumnRenamed("label", "group"), pairs, PERMS)
    assert "md5" not in planned(df)
    y = np.arange(N) ** 2 % 3
    mean = lambda v, k, g: x[v == k, g].mean()
    score = lambda v, r: (mean(v, r["source"], r["ligand"]) + mean(v, r["target"], r["receptor"])) / 2
    got = df.collect()
    assert len(got) == 2 * len(set(y)) ** 2
    for r in got:
        assert np.isclose(r["p"], np.mean([score(y[drawn(p)], r) >= score(y, r) - 1e-12 for p in range(1, PERMS + 1)]))


def test_neighbourhoods(graph):
    e, edges, labels = graph
    df = spatial.neighbourhood_enrichment(edges, labels, PERMS)
    assert "md5" not in planned(df)
    y = np.arange(N) ** 2 % 3
    for r in df.collect():
        at = lambda v: sum(v[a] == r["label_a"] and v[b] == r["label_b"] for a, b in e)
        c = np.array([at(y[drawn(p)]) for p in range(1, PERMS + 1)])
        assert r["n"] == at(y) and (not c.std() or np.isclose(r["zscore"], (at(y) - c.mean()) / c.std()))


def test_global_similarity(spark, graph):
    _, edges, labels = graph
    expr = labels.select("obs_id", F.explode(F.array(*[F.struct(F.lit(g).alias("gene_id"), F.sin(F.col("obs_id") * (g + 1)).alias("value")) for g in range(3)])).alias("s")).select("obs_id", "s.*")
    df = communication.global_similarity(expr, edges, spark.createDataFrame([(0, 1), (1, 2)], "ligand int, receptor int"), PERMS)
    assert "md5" not in planned(df) and df.count() == 2
    assert permutations.CHUNKS < PERMS


def test_values_are_dealt_to_tasks_in_shares(spark, graph, monkeypatch):
    """A task holds so many numbers at most; fewer chunks of permutations keep the copies of the table few."""
    e, edges, _ = graph
    values = spark.range(N).withColumnRenamed("id", "obs_id").select("obs_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("gene_id")).withColumn("value", F.sin(F.col("obs_id") * (F.col("gene_id") + 1)))
    pairs = spark.createDataFrame([(g, g + 1) for g in range(6)], "ligand long, receptor long")

    def made():
        local = spatial.local_morans_p(edges, values, PERMS).select("obs_id", "gene_id", "p_sim").orderBy("obs_id", "gene_id").collect()
        return local, communication.global_similarity(values, edges, pairs, PERMS).orderBy("ligand").collect()

    whole = made()
    plain = permutations._matrix

    def watched(rows, column):
        got = plain(rows, column)
        assert "share" not in rows.column_names or got.shape[1] <= 2, got.shape  # else it is a batch that streams past
        return got

    monkeypatch.setattr(permutations, "HELD", 2 * N)
    monkeypatch.setattr(permutations, "_matrix", watched)
    assert made()[0] == whole[0]
    got = made()[1]
    assert [(r["ligand"], r["p"]) for r in got] == [(r["ligand"], r["p"]) for r in whole[1]]
    x = np.sin(np.outer(np.arange(N), np.arange(1, 8)))
    z = x - x.mean(axis=0)
    lag = np.stack([z[[b for a, b in e if a == i]].mean(axis=0) for i in range(N)])
    for r in got:
        a, b = r["ligand"], r["receptor"]
        down = np.sqrt((z[:, a] ** 2).sum() * (z[:, b] ** 2).sum())
        assert np.isclose(r["moran"], z[:, a] @ lag[:, b] / down) and np.isclose(r["lee"], lag[:, a] @ lag[:, b] / down)
