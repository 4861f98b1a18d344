import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import errors, model, registry
from cellweave.functions import stats
from cellweave.operators import annotation, communication, dynamics, embedding, enrichment, integration, markers, neighbors, preprocess, spatial


def points(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(8, 0.2, (n - n // 2, 2))])
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "obs_id long, x double, y double"), xy


@pytest.mark.parametrize("small", [neighbors.SMALL, 0])
def test_knn_is_exact_on_uneven_points(spark, monkeypatch, small):
    monkeypatch.setattr(neighbors, "SMALL", small)
    df, xy = points(spark)
    d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {i: [int(j) for j in np.lexsort((np.arange(len(xy)), d[i]))[:5]] for i in range(len(xy))}
    got: dict = {}
    for r in neighbors.knn(df, 5).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == want


@pytest.mark.parametrize("include_self", [False, True])
def test_knn_deals_out_crowded_tiles(spark, monkeypatch, include_self):
    """No task takes all pairs of a tile: points beyond a share are dealt out, and their nearest meet afterwards."""
    monkeypatch.setattr(neighbors, "SHARE", 16)
    one = neighbors._nearest
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 1, (150, 2)), np.zeros((40, 2)), rng.normal(30, 0.1, (100, 2)), [[500.0, -500.0]]]).round(2)
    df = spark.createDataFrame([(f"p{i:03}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "obs_id string, x double, y double")

    def bounded(rows, k, include_self):
        if len(rows) > 90:
            raise AssertionError("a task holds a crowded tile")
        return one(rows, k, include_self)

    monkeypatch.setattr(neighbors, "_nearest", bounded)
    d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    if not include_self:
        np.fill_diagonal(d, np.inf)
    want = {f"p{i:03}": [f"p{j:03}" for j in np.lexsort((np.arange(len(xy)), d[i]))[:7]] for i in range(len(xy))}
    got: dict = {}
    for r in neighbors.knn(df, 7, include_self, small=0).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == want


def test_knn_of_few_points(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0)], "obs_id long, x double, y double")
    assert neighbors.knn(one, 3).count() == 0
    assert neighbors.knn(one.where("false"), 3).count() == 0


def test_components_and_hops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "src long, dst long")
    nodes = spark.range(40).withColumnRenamed("id", "obs_id")
    got = {r["obs_id"]: r["component"] for r in neighbors.connected(e, nodes).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30 and got[39] == 39
    far = neighbors.hops(e, nodes.where("obs_id < 4"), 30)
    assert far.agg(F.max("hops")).first()[0] == 20


def test_normal_tail(spark):
    z = [-8.0, -3.0, -1.0, 0.0, 0.5, 2.0, 5.0, 7.5]
    df = spark.createDataFrame([(v,) for v in z], "z double").select(stats.normal_upper_tail(F.col("z")).alias("p"))
    for v, r in zip(z, df.collect(), strict=True):
        assert math.isclose(r["p"], 0.5 * math.erfc(v / math.sqrt(2)), rel_tol=1e-7)


@pytest.mark.parametrize("method", ["bh", "by", "bonferroni", "sidak"])
def test_corrections(spark, method):
    p = [0.01, 0.04, 0.03, 0.2, 0.5]
    got = [r["q"] for r in stats.adjust(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), method=method, order=("i",)).orderBy("i").collect()]
    m, c = len(p), sum(1 / k for k in range(1, 6)) if method == "by" else 1
    order = np.argsort(p)
    want = np.empty(m)
    low = 1.0
    for k in range(m, 0, -1):
        low = min(low, p[order[k - 1]] * m * c / k)
        want[order[k - 1]] = low
    if method == "bonferroni":
        want = np.minimum(1, np.array(p) * m)
    if method == "sidak":
        want = 1 - (1 - np.array(p)) ** m
    assert np.allclose(got, want)


def test_harmony_and_centring_keep_shape(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(i % 2 * 3, 1, 4)]) for i in range(80)]
    v = spark.createDataFrame(rows, "obs_id long, batch string, v array<double>")
    for fixed in (integration.harmonise(v, 3, 5), integration.centre_batches(v)):
        got = fixed.toPandas()
        a, b = (np.stack(got[got["batch"] == x]["v"]).mean(axis=0) for x in "ab")
        assert len(got) == 80 and np.abs(a - b).max() < 1.5


def test_louvain_finds_two_cliques():
    edges = [(a, b, 1.0) for a in range(6) for b in range(a)] + [(a + 6, b + 6, 1.0) for a in range(6) for b in range(a)] + [(0, 6, 1.0)]
    got = embedding.louvain(edges)
    assert len(set(got.values())) == 2 and len({got[i] for i in range(6)}) == 1


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "obs_id long, v array<double>")
    got, _, var = embedding.pca(v, 3)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(var, s[:3] ** 2 / 59) and got.count() == 60


def test_doublets_and_subsample(spark):
    e = spark.createDataFrame([(i, g, 1.0) for i in range(10) for g in range(3)], "obs_id long, gene_id long, value double")
    obs = e.select("obs_id").distinct()
    assert preprocess.simulate_doublets(e, obs).select("obs_id").distinct().count() == 20
    assert preprocess.subsample(obs, 4).collect() == preprocess.subsample(obs, 4).collect()
    with pytest.raises(errors.DataError):
        preprocess.require_counts(e.withColumn("value", F.lit(0.5)))


def test_absorption_and_kernel(spark):
    k = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.5)], "src long, dst long, w double")
    ends = spark.createDataFrame([(0, "a"), (3, "b")], "obs_id long, fate string")
    p = {(r["obs_id"], r["fate"]): r["p"] for r in dynamics.absorption(k, ends, 60).collect()}
    assert math.isclose(p[1, "a"], 2 / 3, rel_tol=1e-6)


def test_annotation_assigns_unknown(spark):
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", -1.0), (2, "b", 0.0)], "obs_id long, cell_type string, score double")
    got = {r["obs_id"]: r["cell_type"] for r in annotation.assign(s).collect()}
    assert got == {1: "a", 2: annotation.UNKNOWN}


def test_pair_names(spark):
    df = spark.createDataFrame([("x:A^B_C",), ("A_B-C",), ("A-B",), ("A",)], "n string").select(communication.parse_pair(F.col("n")).alias("p"))
    assert [tuple(r["p"]) for r in df.collect()] == [("A", "B_C"), ("A", "B-C"), ("A", "B"), ("A", None)]


def test_wald_finds_the_changed_gene(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", "ab"[i % 2], g, float(rng.poisson(50 * (4 if g == 0 and i % 2 == 0 else 1)))) for i in range(8) for g in range(20)]
    bulk = spark.createDataFrame(rows, "sample string, condition string, gene_id long, value double")
    got = markers.negative_binomial_wald(bulk, markers.size_factors(bulk), "a", "b").orderBy("p").first()
    assert got["gene_id"] == 0 and got["log2fc"] > 1.5


def test_gene_spellings(spark):
    want = spark.createDataFrame([("ACTB",), ("cd3e",), ("nope",)], "wanted string")
    genes = spark.createDataFrame([("Actb",), ("CD3E",)], "gene_id string")
    assert {r["wanted"]: r["gene_id"] for r in enrichment.matched_genes(want, genes).collect()} == {"ACTB": "Actb", "cd3e": "CD3E"}


def test_registry_and_stubs():
    assert "morans_i" in registry.methods("statistics")
    with pytest.raises(errors.DependencyError):
        registry.method("deconvolution", "cell2location")(None, None)
    with pytest.raises(errors.ParameterError):
        registry.method("statistics", "nothing")


def test_model_layers(spark):
    expr = spark.createDataFrame([(1, "g", "X", 1.0), (2, "g", "X", 2.5)], "obs_id long, gene_id string, layer string, value double")
    data = model.after_load(model.SpatialData(expr.select("obs_id").distinct(), expr.select("gene_id").distinct(), expr))
    assert data.layers() == {"X", "raw", "counts"} and model.resolve_layer(data) == "raw"
    with pytest.raises(errors.DataError):
        model.resolve_layer(data, require_counts=True)
    graph = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert data.with_graph("knn", graph, k=6).has_graph("knn", k=6) and not data.with_graph("knn", graph, k=6).has_graph("knn", k=8)
    names = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "gene_id string, ord int")
    assert sorted(r["gene_id"] for r in model.unique_names(names).collect()) == ["a", "a-1", "b"]


def test_geary_of_constant_gene_is_left_out(spark):
    v = spark.createDataFrame([(i, 1, 1.0) for i in range(12)], "obs_id long, gene_id int, value double")
    e = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "src long, dst long")
    assert spatial.gearys_c(e, v).count() == 0


def test_centralities_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    nodes = spark.range(5).withColumnRenamed("id", "obs_id")
    b = {r["obs_id"]: r["betweenness"] for r in spatial.betweenness(e, nodes).collect()}
    assert np.allclose([b[i] for i in range(5)], [0, 0.5, 2 / 3, 0.5, 0])
    c = {r["obs_id"]: r["closeness"] for r in spatial.closeness(e, nodes).collect()}
    assert math.isclose(c[2], 4 / 6) and math.isclose(c[0], 4 / 10)


def test_kernel_test_finds_the_gradient(spark):
    from cellweave.operators import spatial_genes

    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1, (200, 2))
    coords = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "obs_id long, x double, y double")
    rows = [(i, g, float(rng.poisson(20 * xy[i, 0] if g == 0 else 5))) for i in range(200) for g in range(10)]
    got = spatial_genes.spatially_variable(spark.createDataFrame([r for r in rows if r[2]], "obs_id long, gene_id long, value double"), coords)
    assert [r["gene_id"] for r in spatial_genes.top_genes(got).collect()] == [0]


def test_default_permutations_reach_small_p(spark):
    e = spark.createDataFrame([(i, 30 * (i // 30) + (i + k) % 30) for i in range(60) for k in range(1, 7)], "src long, dst long")
    labels = spark.createDataFrame([(i, i // 30) for i in range(60)], "obs_id long, label long")
    p = [r["p_sim"] for r in spatial.local_join_count_p(e, labels).collect()]
    assert len(p) == 60 and max(p) < 0.05 and all(math.isclose(x * 1000, round(x * 1000), abs_tol=1e-9) for x in p) and min(p) < 0.01
    values = labels.select("obs_id", F.lit(1).alias("gene_id"), F.col("label").cast("double").alias("value"))
    p = [r["p_sim"] for r in spatial.local_morans_p(e, values).collect()]
    assert len(p) == 60 and all(math.isclose(x * 1000, round(x * 1000), abs_tol=1e-9) for x in p) and min(p) < 0.01


def test_default_permutations_of_pairs_and_sets(spark):
    import inspect

    for f, n in ((communication.pair_p_values, 1000), (enrichment.prerank, 1000), (spatial.neighbourhood_enrichment, 1000)):
        assert inspect.signature(f).parameters["permutations"].default == n
    ranking = spark.createDataFrame([(g, 30.0 - g) for g in range(60)], "gene_id long, score double")
    sets = spark.createDataFrame([("top", g) for g in range(8)], "set_name string, gene_id long")
    assert enrichment.prerank(ranking, sets).first()["p"] < 0.01


def test_kendall_of_all_genes_against_brute_force(spark):
    from cellweave.operators import plotdata

    rng = np.random.default_rng(4)
    v = {g: rng.integers(0, 4 + 9 * g, 60).astype(float) if g else np.ones(60) for g in range(9)}
    df = spark.createDataFrame([(i, g, float(x)) for g, xs in v.items() for i, x in enumerate(xs) if (g, i) != (3, 5)], "obs_id long, gene_id int, value double")
    got = {(r["gene_a"], r["gene_b"]): r["r"] for r in plotdata.correlations(df, "kendall").collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        keep = np.arange(60) != 5 if 3 in (a, b) else np.ones(60, bool)
        s, t = (np.sign(x[keep][:, None] - x[keep][None]) for x in (v[a], v[b]))
        assert r is None if a == 0 else math.isclose(r, (s * t).sum() / math.sqrt((s * s).sum() * (t * t).sum()), abs_tol=1e-12)


def test_full_queries_leave_no_gene_out(spark):
    import __spark_entry__ as entry_module

    q, d = entry_module.queries(), "/root/testdata/sf0.001"
    assert q["kendall_corr"](spark, d).count() == 62 * 61 // 2
    c = spark.read.parquet(f"{d}/lineitem.parquet")
    got = q["pearson_residuals"](spark, d)
    assert got.select("gene_id").distinct().count() == c.select("l_partkey").distinct().count()


def test_absorption_reaches_far_states(spark):
    k = spark.createDataFrame([(i, i - 1, 1.0) for i in range(1, 121)], "src long, dst long, w double")
    got = dynamics.absorption(k, spark.createDataFrame([(0, "a")], "obs_id long, fate string")).collect()
    assert len(got) == 121 and all(r["p"] == 1.0 for r in got)


def test_bounds_that_are_hit_raise(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    nodes = spark.range(7).withColumnRenamed("id", "obs_id")
    with pytest.raises(RuntimeError):
        neighbors.hops(e, nodes, 3)
    with pytest.raises(RuntimeError):
        neighbors.connected(e, nodes, 1)
    assert neighbors.hops(e, nodes, 6).count() == 42


def test_pearson_residuals_are_made_where_they_are_used(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.poisson(1.0, (30, 20)) + np.eye(30, 20)
    rows = [(f"c{i}", f"g{j}", float(x[i, j])) for i in range(30) for j in range(20) if x[i, j]]
    expr = spark.createDataFrame(rows, "obs_id string, gene_id string, value double")
    monkeypatch.setattr(preprocess, "densify", None)  # a row for each cell and gene, joined with the counts
    monkeypatch.setattr(preprocess, "OBS_BLOCK", 4)
    monkeypatch.setattr(preprocess, "GENE_BLOCK", 6)
    got = preprocess.pearson_residuals(expr, expr.select("obs_id").distinct(), expr.select("gene_id").where("gene_id <> 'g3'")).collect()
    assert len(got) == len({(r["obs_id"], r["gene_id"]) for r in got}) == (x.sum(axis=1) > 0).sum() * 19
    for r in got:
        i, j = int(r["obs_id"][1:]), int(r["gene_id"][1:])
        mu, n = x[i].sum() * x[:, j].sum() / x.sum(), (x.sum(axis=1) > 0).sum()
        assert r["residual"] == pytest.approx(np.clip((x[i, j] - mu) / np.sqrt(mu + mu * mu / 100), -np.sqrt(n), np.sqrt(n)))
