"""Entries over whole datasets, and operators that no query with an oracle reaches."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import errors, model, workflow
from cellweave.functions import stats
from cellweave.model import SpatialData
from cellweave.operators import communication, cnv, domains, dynamics, embedding, enrichment, markers, neighbors, preprocess, profile, spatial, spatial_genes, summaries
from cellweave.sources import readers, sinks
from cellweave.storage import cut


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n, m = 120, 40
    kind = np.arange(n) % 2
    x = rng.poisson(2, (n, m)) + kind[:, None] * rng.poisson(4, (n, m)) * (np.arange(m) < 10)
    obs = spark.createDataFrame([(i, "ab"[kind[i]], i % 3) for i in range(n)], "obs_id long, type string, batch int").persist()
    var = spark.createDataFrame([(g, g % 4 != 0) for g in range(m)], "gene_id long, highly_variable boolean").persist()
    expr = spark.createDataFrame([(i, g, layer, float(x[i, g])) for i in range(n) for g in range(m) if x[i, g] for layer in ("X", "counts")], "obs_id long, gene_id long, layer string, value double").persist()
    coords = spark.createDataFrame([(i, float(rng.normal() + 5 * kind[i]), float(rng.normal())) for i in range(n)], "obs_id long, x double, y double").persist()
    return SpatialData(obs, var, expr, coords)


def test_student_tail_against_integration(spark):
    def area(t, v, n=200_000):
        lo = math.atan(abs(t) / math.sqrt(v))
        x = np.linspace(lo, lo + min(math.pi / 2 - lo, 40 / math.sqrt(v)), n)
        y = np.cos(x).clip(0) ** (v - 1)
        return 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - math.log(math.pi) / 2) * (x[1] - x[0]) * (y.sum() - (y[0] + y[-1]) / 2)

    rows = [(float(t), float(v)) for v in (1.5, 3, 27.4, 900, 9000, 40_000) for t in (0, 0.01, -1, 2.5, 7)]
    for r in stats.student_two_sided(spark.createDataFrame([*rows, (None, 2.0)], "t double, df double")).collect():
        assert (r["p"] is None) if r["t"] is None else math.isclose(r["p"], area(r["t"], r["df"]), rel_tol=1e-4, abs_tol=1e-7)


def test_embeddings_are_built_once(data):
    one, computed, skipped = workflow.compute_embeddings(data, ("clusters", "spatial_neighbors"), n_components=5, k=8)
    assert computed == ["pca", "neighbors", "clusters", "spatial_neighbors"] and not skipped
    _, computed, skipped = workflow.compute_embeddings(one, ("clusters",), n_components=5, k=8)
    assert not computed and skipped == ["pca", "neighbors", "clusters"]
    assert workflow.compute_embeddings(one, ("pca",), n_components=4, force=True)[1] == ["pca"]
    assert one.graphs[model.graph_key("neighbors", k=8)].where("w <= 0 or w > 1").count() == 0
    with pytest.raises(errors.ParameterError):
        workflow.compute_embeddings(data, ("tsne",))


def test_save_and_reload_everything(spark, data, tmp_path):
    full, _, _ = workflow.compute_embeddings(data, ("neighbors", "spatial_neighbors"), n_components=4, k=5)
    sinks.save(full, f"{tmp_path}/d")
    again = readers.load(spark, f"{tmp_path}/d")
    assert again.graphs.keys() == full.graphs.keys() and again.vectors.keys() == full.vectors.keys() and again.log == full.log
    for name, df in full.graphs.items():
        assert sorted(map(tuple, again.graphs[name].select(sorted(df.columns)).collect())) == sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert again.layer("X").count() == full.layer("X").count()


def test_profile_and_features(data):
    got = profile.dataset(data)
    sums = {r["gene_id"]: r["s"] for r in data.layer("X").groupBy("gene_id").agg(F.sum("value").alias("s")).collect()}
    assert got["n_obs"] == 120 and got["n_genes"] == 40 and got["layers"] == ["X", "counts"] and got["spatial"]
    assert got["top_expressed"] == sorted(sums, key=lambda g: (-sums[g], g))[:10] and got["top_variable"] == [1, 2, 3, 5, 6, 7, 9, 10, 11, 13]
    assert {c["column"]: c["n_unique"] for c in got["columns"]} == {"type": 2, "batch": 3}
    assert model.resolve_feature(data, "3").count() == 120 and model.resolve_feature(data, "type").first()["value"] in "ab"
    two = data.with_vectors("pca", data.obs.select("obs_id", F.array(F.lit(1.0), F.lit(2.0)).alias("v")))
    assert {r["value"] for r in model.resolve_feature(two, "pca_1").collect()} == {2.0}
    with pytest.raises(errors.MissingDataError):
        model.resolve_feature(data, "nothing")
    assert model.categorical_columns(data) == ["type", "batch"]
    assert model.categorical_columns(data, 2) == ["type"]


def test_integration_registration_and_cnv(spark, data):
    shifted = SpatialData(data.obs, data.var, data.expr.where("gene_id < 35"), data.coords.select("obs_id", (F.col("x") * 3 + 50).alias("x"), (F.col("y") * 3 - 7).alias("y")))
    name, out = workflow.integrate({"one": data, "two": shifted}, "harmony", 5)
    assert name == "integrated_one-two" and out["vectors"].count() == 240 and out["expr"].where("gene_id >= 35").count() == 0
    assert workflow.integrate({"a": data, "b": shifted}, "mnn", 5)[1]["graph"].where("split(a, ':')[0] = split(b, ':')[0]").count() == 0
    moved = workflow.register(data, shifted, blur=0.005)
    both = moved.coords.join(shifted.coords.withColumnsRenamed({"x": "tx", "y": "ty"}), "obs_id")
    assert both.count() == 120 and both.agg(F.corr("x", "tx")).first()[0] > 0.9
    genes = data.var.select("gene_id", F.lit("chr1").alias("chromosome"), F.col("gene_id").alias("pos"))
    got, bins = workflow.infer_cnv(data, "type", ["a"], genes, 10, 5, cluster=True)
    assert {"cnv_score", "cnv_cluster"} <= set(got.obs.columns) and bins.select("bin").distinct().count() == 7
    with pytest.raises(errors.ParameterError):
        workflow.infer_cnv(data, "type", ["c"], genes)
    assert cnv.statistics(bins).first()["n_cells"] == 120


def test_transport_plan_matches_itself(spark):
    v = spark.createDataFrame([(i, [float(i), float(i % 5)]) for i in range(30)], "obs_id long, v array<double>")
    plan = dynamics.transport(v, v, blur=0.001)
    assert plan.where("obs_id = ref_id and w > 0.99").count() == 30
    assert plan.groupBy("obs_id").agg(F.sum("w").alias("s")).where("abs(s - 1) > 1e-4").count() == 0
    assert dynamics.transport(v, v.where("false")).count() == 0
    with pytest.raises(errors.DataError):
        dynamics.transport(v, v, most=10)


def test_trajectory_goes_by_what_there_is(spark, data):
    method, t = workflow.trajectory(data, root=0, k=6)
    assert method == "diffusion" and t.where("pseudotime between 0 and 1").count() == t.count()
    with pytest.raises(errors.ParameterError):
        workflow.trajectory(data)
    both = data.with_layer("spliced", data.layer("X")).with_layer("unspliced", data.layer("X").withColumn("value", F.col("value") * (1 + F.col("obs_id") % 3)))
    method, t = workflow.trajectory(both, k=6)
    assert method == "velocity" and t.count() == 120 and t.where("norm < 0 or confidence > 1.0001").count() == 0


def test_velocity_graph_is_the_cosine(spark):
    v = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, -1.0), (1, 1, 1.0), (2, 0, 0.0), (2, 1, 0.0)], "obs_id long, gene_id long, velocity double")
    m = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 2.0), (1, 1, 2.0), (2, 0, 0.0), (2, 1, 0.0)], "obs_id long, gene_id long, ms double")
    e = spark.createDataFrame([(0, 1), (1, 0), (0, 2), (2, 1)], "src long, dst long")
    got = {(r["src"], r["dst"]): round(r["cosine"], 9) for r in dynamics.velocity_graph(v, m, e).collect()}
    assert got == {(0, 1): round(1 / math.sqrt(2), 9), (1, 0): 0.0, (0, 2): 0.0, (2, 1): 0.0}


def test_caches_convergence_and_paths(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert workflow.cached(spark, "t", {"a": str(tmp_path)}, make).count() == workflow.cached(spark, "t", {"a": str(tmp_path)}, make).count() == 3
    assert len(made) == 1
    assert workflow.converged([1.0] * 60) and not workflow.converged([1.0] * 10) and not workflow.converged([float(i) for i in range(1, 80)])
    assert workflow.writable(spark, f"file://{tmp_path}/x") == f"file://{tmp_path}/x"
    assert workflow.writable(spark, "file:///proc/nowhere").endswith("/nowhere") and "proc" not in workflow.writable(spark, "file:///proc/nowhere")


def test_preprocessing_in_one_call(data):
    genes = preprocess.flag_genes(data.var)
    out = preprocess.pipeline(data.layer("counts"), genes, min_genes=5, n_hvg=20, doublets=True, scaled=True, sample_cells=110, sample_genes=15)
    assert set(out) == {"qc", "raw", "doublets", "counts", "normalised", "hvg", "scaled"}
    assert out["raw"].select("obs_id").distinct().count() == 120 and out["doublets"].count() == 110
    assert out["counts"].select("gene_id").distinct().count() == 15 == out["hvg"].count()
    left = out["counts"].select("obs_id").distinct().count()
    assert left == 110 - out["doublets"].where("doublet").count() and out["scaled"].count() == 15 * left
    assert "residual" not in preprocess.pipeline(data.layer("counts"), genes, min_genes=5, n_hvg=10, normalisation="pearson")["normalised"].columns
    with pytest.raises(errors.ParameterError):
        preprocess.pipeline(data.layer("counts"), genes, normalisation="other")


def test_doublets_score_higher(spark):
    rng = np.random.default_rng(0)
    a, b = rng.poisson(6, (100, 30)) * (np.arange(30) < 15), rng.poisson(6, (100, 30)) * (np.arange(30) >= 15)
    cells = np.concatenate([a, b, a[:12] + b[:12]])
    e = spark.createDataFrame([(i, g, float(cells[i, g])) for i in range(len(cells)) for g in range(30) if cells[i, g]], "obs_id long, gene_id long, value double")
    got = {r["obs_id"]: r["score"] for r in preprocess.doublet_scores(e, e.select("obs_id").distinct(), n_components=5).collect()}
    assert np.mean([got[i] for i in range(200, 212)]) > 3 * np.mean([got[i] for i in range(200)])
    few = e.where("obs_id < 50")
    assert preprocess.doublet_scores(few, few.select("obs_id").distinct()).where("doublet or score > 0").count() == 0


def test_flags_and_variable_genes(spark):
    g = preprocess.flag_genes(spark.createDataFrame([("MT-A",), ("mt-b",), ("RPS1",), ("Rpl2",), ("XMT-A",)], "gene_id string"))
    assert {r["gene_id"]: (r["mt"], r["ribo"]) for r in g.collect()} == {"MT-A": (True, False), "mt-b": (True, False), "RPS1": (False, True), "Rpl2": (False, True), "XMT-A": (False, False)}
    d = spark.createDataFrame([(i, float(i), float(-i)) for i in range(10)], "gene_id long, mean double, norm_dispersion double")
    assert [r["gene_id"] for r in preprocess.variable_genes(d, 3, min_mean=2).collect()] == [2, 3, 4]
    assert preprocess.variable_genes(d, 3, drop=d.where("gene_id = 0")).count() == 2
    with pytest.raises(errors.ParameterError):
        preprocess.variable_genes(d, 0)


def test_names_and_size_line(spark, tmp_path):
    names = spark.createDataFrame([("a", 1), ("a", 2), ("a-1", 3), ("b", 4), ("a", 5)], "gene_id string, ord int")
    assert [r["gene_id"] for r in model.unique_names(names).orderBy("ord").collect()] == ["a", "a-2", "a-1", "b", "a-3"]
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 3\n1 1 5\n2 2 3\n1 2 1\n")
    (tmp_path / "barcodes.tsv").write_text("A\nB\n")
    (tmp_path / "genes.tsv").write_text("g1\ng2\n")
    _, _, expr = readers.matrix_market(spark, str(tmp_path))
    assert {(r[0], r[1], r[3]) for r in expr.collect()} == {("A", "g1", 5.0), ("B", "g2", 3.0), ("B", "g1", 1.0)}


def test_imaging_cells(spark, tmp_path):
    m = tmp_path / "cell_feature_matrix"
    m.mkdir()
    with gzip.open(m / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 1 5\n2 2 4\n")
    (m / "barcodes.tsv").write_text("c1\nc2\n")
    (m / "features.tsv").write_text("i1\tG1\ni2\tG2\n")
    with gzip.open(tmp_path / "cells.csv.gz", "wt") as f:
        f.write("cell_id,x_centroid,y_centroid,cell_area\nc1,1.5,2.5,9\n")
    data = readers.load(spark, str(tmp_path), "xenium")
    assert [tuple(r) for r in data.coords.collect()] == [("c1", 1.5, 2.5)] and data.layer("raw").count() == 1 and data.obs.first()["cell_area"] == 9.0


def test_validators(spark, data):
    model.check_coordinates(data.coords)
    model.check_basics(data, 10, 10)
    for bad in (data.coords.where("false"), data.coords.withColumn("x", F.lit(float("nan"))), data.coords.select("obs_id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))):
        with pytest.raises(errors.DataError):
            model.check_coordinates(bad)
    with pytest.raises(errors.DataError):
        model.check_basics(data, 1000)
    with pytest.raises(errors.MissingDataError):
        model.check_velocity_layers(data)
    assert [r[0] for r in model.select_genes(data, ["3", "x"]).collect()] == ["3"] and model.select_genes(data, n=5).count() == 5
    with pytest.raises(errors.MissingDataError):
        model.select_genes(data, ["none"])


def test_limits_are_errors(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    nodes = spark.range(13).withColumnRenamed("id", "obs_id")
    with pytest.raises(RuntimeError):
        neighbors.hops(e, nodes, 3)
    with pytest.raises(RuntimeError):
        neighbors.connected(e, nodes, 1)
    with pytest.raises(RuntimeError):
        embedding.label_propagation(e, nodes, 1)
    assert embedding.label_propagation(e, nodes).count() == 13
    with pytest.raises(errors.ParameterError):
        spatial.join_count_p(e, nodes.withColumn("label", F.col("obs_id") % 3))
    with pytest.raises(errors.ParameterError):
        spatial.getis_ord(e, nodes.select("obs_id", F.lit(1).alias("gene_id"), F.col("obs_id").cast("double").alias("value")), correction="none at all")


def test_gene_rows_fill_what_is_missing(spark):
    v = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 2, 4.0)], "obs_id long, gene_id long, value double")
    got = {r["obs_id"]: (list(r["genes"]), list(r["v"])) for r in spatial.gene_rows(v).collect()}
    assert got == {1: ([1, 2], [2.0, 3.0]), 2: ([1, 2], [0.0, 4.0])}


def test_fuzzy_weights_sum_to_the_log(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)], "obs_id long, v array<double>")
    w = neighbors.fuzzy_weights(neighbors.vector_knn(v, 8))
    assert w.where("w <= 0 or w > 1").count() == 0
    back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("b"))
    assert w.join(back, ["src", "dst"]).where("abs(w - b) > 1e-9").count() == 0 and w.join(back, ["src", "dst"]).count() == w.count()


def test_summaries_of_all_analyses(spark, data):
    g = neighbors.knn(data.coords, 5)
    labels = data.obs.select("obs_id", F.col("type").alias("label"))
    values = preprocess.densify(data.layer("X").where("gene_id < 6"), data.obs, data.var.where("gene_id < 6"))
    tested = spatial.local_join_count_p(g, labels, 19)
    results = {
        "geary": spatial.gearys_c(g, values),
        "getis_ord": spatial.getis_summary(spatial.getis_ord(g, values)),
        "bivariate_moran": spatial.bivariate_moran(g, values, spark.createDataFrame([(0, 1), (2, 3)], "gene_x long, gene_y long")),
        "neighbourhood": spatial.neighbourhood_enrichment(g, labels, 20),
        "co_occurrence": spatial.co_occurrence(data.coords, labels, 5),
        "ripley": spatial.ripley_l(data.coords, labels, 5),
        "centrality": domains.group_closeness(g, labels),
        "join_count": spatial.join_count_p(g, labels, 19),
        "local_join_count": spatial.local_join_summary(tested, 0.2),
        "network": spatial.network_properties(g, data.obs),
    }
    want = {"geary": 6, "getis_ord": 6, "bivariate_moran": 2, "neighbourhood": 2, "co_occurrence": 2, "ripley": 2, "centrality": 2, "join_count": 2, "local_join_count": 2, "network": 0}
    for name, df in results.items():
        r = summaries.summary(name, df).first()
        assert r["n_features"] == want[name] and len(r["top_features"]) <= 10
    by = {r["label"]: r for r in spatial.local_join_summary(tested, 0.2).collect()}
    plain = [r for r in tested.collect() if r["label"] == "a"]
    assert math.isclose(by["a"]["mean"], np.mean([r["ljc"] for r in plain])) and by["a"]["n_significant"] == sum(r["p_sim"] < 0.2 for r in plain)
    assert {r["label"] for r in spatial.centrality_by_label(neighbors.degree(g), labels, "degree").collect()} == {"a", "b"}
    with pytest.raises(errors.ParameterError):
        summaries.summary("other", results["geary"])


def test_communication_conversions(spark):
    wide = spark.createDataFrame([("A^B", 0.5, 0.0), ("C_D", None, 2.0)], "pair string, `x|y` double, `y|x` double")
    got = {tuple(r) for r in communication.long_pairs(wide).collect()}
    assert got == {("x", "y", "A", "B", 0.5), ("y", "x", "C", "D", 2.0)}
    assert sorted(r["score"] for r in communication.unit_ranks(communication.long_pairs(wide)).collect()) == [0.25, 1.0]
    means = spark.createDataFrame([("g", 1, 2.0), ("g", 2, 4.0), ("h", 1, 1.0)], "group string, gene_id long, mean double")
    members = spark.createDataFrame([("K", 1), ("K", 2)], "complex string, gene_id long")
    assert [tuple(r) for r in communication.complexes(means, members).collect()] == [("g", "K", 2.0)]
    assert [tuple(r) for r in communication.complexes(means, members, "avg").collect()] == [("g", "K", 3.0)]
    expr = spark.createDataFrame([(i, 1, float(i)) for i in range(1, 5)], "obs_id long, gene_id long, value double")
    groups = spark.createDataFrame([(i, "g") for i in range(6)], "obs_id long, group string")
    s = {r["summary"]: r["value"] for r in communication.summaries(expr, groups).collect()}
    x = np.array([0, 0, 1, 2, 3, 4.0])
    q = [np.quantile(x, p) for p in (0.25, 0.5, 0.75)]
    assert math.isclose(s["mean"], x.mean()) and math.isclose(s["median"], q[1]) and math.isclose(s["q3"], q[2]) and math.isclose(s["trimean"], (q[0] + 2 * q[1] + q[2]) / 4)
    p = communication.interaction_probability(expr, groups, spark.createDataFrame([(1, 1)], "ligand long, receptor long")).first()["probability"]
    assert math.isclose(p, s["trimean"] ** 2 / (0.5 + s["trimean"] ** 2))
    with pytest.raises(errors.ParameterError):
        communication.local_similarity(expr, spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([(1, 1)], "ligand long, receptor long"), "other")


def test_local_spearman_is_pearson_of_ranks(spark, data):
    g = neighbors.knn(data.coords, 6)
    values = preprocess.densify(data.layer("X").where("gene_id < 2"), data.obs, data.var.where("gene_id < 2"))
    pair = spark.createDataFrame([(0, 1)], "ligand long, receptor long")
    ranks = values.select("obs_id", "gene_id", stats.average_rank("value", ("gene_id",)).alias("value"))
    a = {r["obs_id"]: r["local"] for r in communication.local_similarity(values, g, pair, "spearman").collect()}
    b = {r["obs_id"]: r["local"] for r in communication.local_similarity(ranks, g, pair, "pearson").collect()}
    assert a.keys() == b.keys() and all(x is None and b[k] is None or math.isclose(x, b[k], abs_tol=1e-9) for k, x in a.items())


def test_enrichment_filters(spark):
    r = spark.createDataFrame([("a", 0.01), ("b", 0.1), ("c", 0.5)], "set_name string, q double")
    assert enrichment.significant(r).count() == 1 and enrichment.significant(r, "gsea").count() == 2
    var = spark.createDataFrame([("Actb", True), ("GAPDH", False), ("tp53", True)], "gene_id string, highly_variable boolean")
    assert {x[0] for x in enrichment.query_genes(["ACTB", "gapdh", "none"], var).collect()} == {"Actb", "GAPDH"}
    assert {x[0] for x in enrichment.query_genes(None, var, n=1).collect()} == {"Actb"}
    with pytest.raises(errors.ParameterError):
        enrichment.query_genes(["none"], var)
    with pytest.raises(errors.ParameterError):
        enrichment.best_sets(r.select("set_name"))
    plane = spark.createDataFrame([(i, "s", 3.0 + 2.0 * (i % 5) - 1.5 * (i // 5)) for i in range(25)], "obs_id long, set_name string, score double")
    xy = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "obs_id long, x double, y double")
    assert enrichment.detrended(plane, xy).where("abs(score) > 1e-9").count() == 0


def test_markers_of_pairs_and_samples(spark, data):
    groups = data.obs.select("obs_id", F.col("type").alias("group"))
    x = data.layer("X")
    assert markers.pairwise(x, groups, "a", "b", markers.t_test).select("group").distinct().first()[0] == "a"
    assert markers.pairwise(x, groups, "b").count() == markers.wilcoxon(x, groups).where("group = 'b'").count()
    with pytest.raises(errors.ParameterError):
        markers.pairwise(x, groups, "a", "z")
    samples = data.obs.select("obs_id", F.col("batch").alias("sample"), F.col("type").alias("condition"))
    with pytest.raises(errors.DataError):
        markers.sample_conditions(samples, 3)
    tested = spark.createDataFrame([(1, 2.0, 0.01), (2, -3.0, 0.01), (3, 1.0, 0.9), (4, 1.0, 0.01)], "gene_id long, log2fc double, q double")
    assert [(r["direction"], r["rank"], r["gene_id"]) for r in markers.regulated(tested, n=1).orderBy("direction").collect()] == [("down", 1, 2), ("up", 1, 1)]


def test_wald_finds_the_gene_that_differs(spark):
    rng = np.random.default_rng(7)
    rows = [(s, s % 2, g, float(rng.poisson(50 * (4 if g == 3 and s % 2 == 0 else 1)))) for s in range(12) for g in range(20)]
    bulk = spark.createDataFrame(rows, "sample int, condition int, gene_id int, value double")
    got = {r["gene_id"]: r for r in markers.negative_binomial_wald(bulk, markers.size_factors(bulk, positive=True), 0, 1).collect()}
    assert got[3]["q"] < 1e-6 and abs(got[3]["log2fc"] - 2) < 0.3 and sum(r["q"] < 0.05 for r in got.values()) <= 2
    assert all(abs(r["log2fc"]) < 0.6 for g, r in got.items() if g != 3)


def test_kernels_fates_and_warnings(spark):
    v = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    s = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (0, 2, 2.0)], "src long, dst long, d double")
    k = {(r["src"], r["dst"]): r["w"] for r in dynamics.transition_kernel(v, v, s, 0.5).collect()}
    e = math.exp(-1.0)
    assert math.isclose(k[0, 1], (0.5 + 0.5 * e) / (0.5 + e)) and math.isclose(k[0, 1] + k[0, 2], 1) and math.isclose(k[1, 0], 1)
    plan = spark.createDataFrame([(0, 5, 1.0), (0, 6, 3.0)], "obs_id long, ref_id long, w double")
    ref = spark.createDataFrame([(5, 0.0, 0.0), (6, 4.0, 8.0)], "obs_id long, x double, y double")
    assert [tuple(r) for r in dynamics.registered(plan, ref).collect()] == [(0, 3.0, 6.0)]
    t = spark.createDataFrame([("RPS1", 0.01), ("RPL2", 0.02), ("X", 0.03)], "gene_id string, q double")
    assert spatial_genes.housekeeping_warning(t) and not spatial_genes.housekeeping_warning(t.where("gene_id = 'X'"))


def test_nnls_meets_its_conditions(spark):
    """Residuals are orthogonal to the types in use and point away from the others."""
    from cellweave.operators import deconvolution

    rng = np.random.default_rng(3)
    a = rng.gamma(1.0, 1.0, (120, 4))
    y = np.maximum(0, rng.dirichlet(np.ones(4) / 2, 25) @ a.T + rng.normal(0, 0.3, (25, 120)))
    x = deconvolution.nnls(a, y)
    slope = (y - x @ a.T) @ a
    assert (x >= 0).all() and (slope[x <= 1e-9] < 1e-4).all() and (np.abs(slope[x > 1e-6]) < 1e-3).all()


def test_logistic_markers_point_at_their_group(spark, data):
    groups = data.obs.select("obs_id", F.col("type").alias("group"))
    dense = preprocess.scale(preprocess.densify(data.layer("X"), data.obs, data.var))
    c = {(r["group"], r["gene_id"]): r["coefficient"] for r in markers.logistic_markers(dense, groups).collect()}
    assert all(c["b", g] > 0 > c["a", g] for g in range(10)) and np.abs([c["b", g] for g in range(20, 40)]).mean() < np.mean([c["b", g] for g in range(10)]) / 3


def test_communities_have_more_modularity_than_halves(spark):
    rng = np.random.default_rng(6)
    kind = np.arange(60) // 20
    edges = [(i, j) for i in range(60) for j in range(i) if rng.random() < (0.5 if kind[i] == kind[j] else 0.03)]
    got = {r["obs_id"]: r["cluster"] for r in embedding.communities(spark.createDataFrame(edges, "src long, dst long"), spark.range(60).withColumnRenamed("id", "obs_id")).collect()}

    def modularity(of):
        deg = np.bincount(np.array(edges).ravel(), minlength=60)
        m = len(edges)
        return sum(of[a] == of[b] for a, b in edges) / m - sum((sum(deg[i] for i in range(60) if of[i] == c) / 2 / m) ** 2 for c in set(of.values()))

    assert modularity(got) >= modularity({i: int(kind[i]) for i in range(60)}) - 0.02
    assert modularity(got) > modularity({i: i % 2 for i in range(60)}) + 0.2


def test_harmony_brings_batches_together_within_clusters(spark):
    """Two batches of two clusters, one batch moved: after correction the clusters of both meet, and stay apart from each other."""
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], [float(v) for v in rng.normal(0, 0.3, 3) + (i // 2 % 2) * np.array([6, 0, 0]) + (i % 2) * np.array([0, 2.0, 1.0])]) for i in range(160)]
    from cellweave.operators import integration

    got = integration.harmonise(spark.createDataFrame(rows, "obs_id long, batch string, v array<double>"), 4, 10).toPandas().sort_values("obs_id")
    x, batch, cluster = np.stack(got["v"]), np.arange(160) % 2, np.arange(160) // 2 % 2
    centre = lambda b, c: x[(batch == b) & (cluster == c)].mean(axis=0)
    assert max(np.linalg.norm(centre(0, c) - centre(1, c)) for c in (0, 1)) < 0.5 < 4 < np.linalg.norm(centre(0, 0) - centre(0, 1))


def _star(spark, obs=40, genes=700, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(o, int(g), float(rng.integers(1, 9)), float(rng.integers(0, 9))) for o in range(obs) for g in rng.choice(genes, 12, replace=False)]
    layers = spark.createDataFrame(rows, "obs_id long, gene_id long, spliced double, unspliced double")
    return layers, spark.createDataFrame([(o, (o + i) % obs) for o in range(obs) for i in (1, 2, 3)], "src long, dst long")



def test_velocity_moments_are_shuffled_once_by_block(spark):
    layers, e = _star(spark)
    v = dynamics.velocity(dynamics.moments(layers, e))
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(gene_id" not in plan and "hashpartitioning(obs_id" not in plan
    m = {(r["obs_id"], r["gene_id"]): (r["ms"], r["mu"]) for r in v.collect()}
    for r in v.where("gene_id < 5").collect():
        of = [x for (_, g), x in m.items() if g == r["gene_id"]]
        assert r["gamma"] == pytest.approx(sum(a * b for a, b in of) / sum(a * a for a, _ in of))


def test_velocity_graph_takes_entries_and_not_every_gene(spark, monkeypatch):
    layers, e = _star(spark)
    monkeypatch.setattr(spatial, "gene_rows", None)  # dense rows: the observations times the genes
    monkeypatch.setattr(dynamics, "BLOCK_ROWS", 100)
    v = cut(dynamics.velocity(dynamics.moments(layers, e)))
    a, b = np.zeros((40, 700)), np.zeros((40, 700))
    for r in v.collect():
        a[r["obs_id"], r["gene_id"]], b[r["obs_id"], r["gene_id"]] = r["velocity"], r["ms"]
    got = dynamics.velocity_graph(v, v, e).collect()
    assert len(got) == 120
    for r in got:
        way = b[r["dst"]] - b[r["src"]]
        assert r["cosine"] == pytest.approx(a[r["src"]] @ way / np.sqrt((a[r["src"]] ** 2).sum() * (way**2).sum()))


def test_velocity_confidence_counts_genes_without_entries(spark, monkeypatch):
    layers, e = _star(spark)
    monkeypatch.setattr(spatial, "gene_rows", None)
    monkeypatch.setattr(dynamics, "BLOCK_ROWS", 100)
    v = cut(dynamics.velocity(dynamics.moments(layers, e)))
    rows = v.collect()
    genes = {g: k for k, g in enumerate(sorted({r["gene_id"] for r in rows}))}
    a = np.zeros((40, len(genes)))
    for r in rows:
        a[r["obs_id"], genes[r["gene_id"]]] = r["velocity"]
    for r in dynamics.velocity_confidence(v, e).collect():
        o = r["obs_id"]
        assert r["confidence"] == pytest.approx(np.mean([np.corrcoef(a[o], a[(o + i) % 40])[0, 1] for i in (1, 2, 3)]))
