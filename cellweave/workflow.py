"""Entries that chain operators over a whole dataset, with what they logged."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.errors import MissingDataError, ParameterError
from cellweave.model import SpatialData, check_velocity_layers, graph_key, resolve_layer
from cellweave.operators import cnv, dynamics, embedding, integration, neighbors, preprocess, spatial
from cellweave.storage import cut, shared_dir

STEPS = ("pca", "neighbors", "clusters", "diffusion", "spatial_neighbors")


def compute_embeddings(data: SpatialData, wanted: tuple[str, ...] = ("pca", "neighbors", "clusters"), n_components: int = 30, k: int = 15, resolution: float = 1.0, spatial_k: int = 6, force: bool = False) -> tuple[SpatialData, list[str], list[str]]:
    """(dataset, computed, skipped): builds what is wanted and what it rests on, in order; what is there already is skipped unless ``force``.

    pca of the variable genes (all genes where none are flagged), the kNN graph of it with fuzzy weights, communities of that
    as column ``cluster``, the diffusion map, and the kNN graph of the coordinates. An unknown step is a ParameterError.
    """
    if unknown := [w for w in wanted if w not in STEPS]:
        raise ParameterError(f"unknown step {', '.join(unknown)}; known: {', '.join(STEPS)}")
    needs = {"neighbors": ("pca",), "clusters": ("pca", "neighbors"), "diffusion": ("pca", "neighbors")}
    order = [s for s in STEPS if s in wanted or any(s in needs.get(w, ()) for w in wanted)]
    computed, skipped = [], []
    there = {"pca": "pca" in data.vectors, "neighbors": data.has_graph("neighbors", k=k), "clusters": "cluster" in data.obs.columns, "diffusion": "diffusion" in data.vectors, "spatial_neighbors": data.has_graph("spatial", k=spatial_k)}
    for step in order:
        if there[step] and not force:
            skipped.append(step)
            continue
        if step == "pca":
            genes = data.var.where("highly_variable") if "highly_variable" in data.var.columns else data.var
            layer = data.layer(resolve_layer(data, complete_genes=False)).join(genes.select("gene_id"), "gene_id", "left_semi")
            dense = preprocess.scale(preprocess.densify(layer, data.obs, genes))
            data = data.with_vectors("pca", cut(embedding.pca(embedding.to_vectors(dense), n_components)[0]))
        elif step == "neighbors":
            data = data.with_graph("neighbors", cut(neighbors.fuzzy_weights(neighbors.vector_knn(data.vectors["pca"], k))), k=k)
        elif step == "clusters":
            found = embedding.communities(data.graphs[graph_key("neighbors", k=k)], data.obs, resolution)
            data = data.with_obs(cut(found.select("obs_id", F.col("cluster").cast("string").alias("cluster"))))
        elif step == "diffusion":
            data = data.with_vectors("diffusion", cut(embedding.diffusion_map(data.graphs[graph_key("neighbors", k=k)])))
        else:
            if data.coords is None:
                raise MissingDataError("no coordinates")
            data = data.with_graph("spatial", cut(neighbors.knn(data.coords, spatial_k)), k=spatial_k)
        computed.append(step)
    return data.logged("embeddings", "+".join(order), {"n_components": n_components, "k": k, "resolution": resolution}, {"computed": computed, "skipped": skipped}), computed, skipped


def integrate(parts: dict[str, SpatialData], method: str = "harmony", n_components: int = 20, k: int = 3) -> tuple[str, dict[str, DataFrame]]:
    """(id, tables): datasets by name joined on their common genes, reduced together, and their batch effect taken out.

    The id is ``integrated_a-b``. Tables: expr (batch, obs_id, gene_id, value; an observation is ``batch:obs_id``), vectors, and for
    bbknn and mnn the graph. Methods: harmony, centre, bbknn, mnn.
    """
    if method not in ("harmony", "centre", "bbknn", "mnn"):
        raise ParameterError(f"unknown integration method {method}")
    names = list(parts)
    tables = [preprocess.normalise(p.layer(resolve_layer(p))) for p in parts.values()]
    tables = [t.withColumn("obs_id", F.concat_ws(":", F.lit(n), F.col("obs_id").cast("string"))) for n, t in zip(names, tables, strict=True)]
    expr = cut(integration.concatenate(tables, names, "inner"))
    obs = expr.select("obs_id", "batch").distinct()
    dense = preprocess.scale(preprocess.densify(expr.select("obs_id", "gene_id", "value"), obs, expr))
    scores = embedding.pca(embedding.to_vectors(dense), n_components)[0].join(obs, "obs_id")
    out = {"expr": expr, "vectors": cut(scores.select("obs_id", "batch", "v"))}
    if method == "harmony":
        out["vectors"] = cut(integration.harmonise(out["vectors"]))
    elif method == "centre":
        out["vectors"] = cut(integration.centre_batches(out["vectors"]))
    elif method == "bbknn":
        out["graph"] = cut(integration.batch_balanced_knn(out["vectors"], k))
    else:
        out["graph"] = cut(integration.mutual_pairs(out["vectors"], k))
    return f"integrated_{'-'.join(names)}", out


def register(source: SpatialData, target: SpatialData, blur: float = 0.05) -> SpatialData:
    """``source`` with its coordinates moved onto ``target``: barycentres of an entropic transport plan over common genes and position."""
    if source.coords is None or target.coords is None:
        raise MissingDataError("both datasets need coordinates")
    sides = []
    common = cut(integration.common_genes([d.layer(resolve_layer(d)).select("gene_id") for d in (source, target)]))
    for d in (source, target):
        values = preprocess.normalise(d.layer(resolve_layer(d))).join(common, "gene_id", "left_semi")
        genes = embedding.to_vectors(preprocess.densify(values, d.obs, common))
        place = integration.align(d.coords.withColumn("batch", F.lit(0)), 0).select("obs_id", "x", "y")
        sides.append(genes.join(place, "obs_id").select("obs_id", F.concat("v", F.array("x", "y")).alias("v")))
    plan = cut(dynamics.transport(*sides, blur=blur))
    from dataclasses import replace

    return replace(source, coords=dynamics.registered(plan, target.coords)).logged("registration", "transport", {"blur": blur})


def infer_cnv(data: SpatialData, column: str, reference: list, genes: DataFrame, window: int = 100, step: int = 10, cluster: bool = False) -> tuple[SpatialData, DataFrame]:
    """(dataset with cnv_score [and cnv_cluster], profile) against the cells whose ``column`` is in ``reference``, which must exist."""
    if column not in data.obs.columns:
        raise MissingDataError(f"no column {column}")
    cells = cnv.reference_cells(data.obs.select("obs_id", F.col(column).alias("group")), reference)
    dense = preprocess.densify(preprocess.normalise(data.layer(resolve_layer(data))), data.obs, genes)
    profile = cut(cnv.infer(dense, genes, cells, window, step))
    found = cnv.cell_scores(profile).withColumnRenamed("score", "cnv_score")
    if cluster:
        found = found.join(cnv.clusters(profile, data.obs).withColumnRenamed("cluster", "cnv_cluster"), "obs_id")
    return data.with_obs(cut(found)).logged("cnv", "running_mean", {"window": window, "step": step, "reference": reference}), profile


def has_velocity(data: SpatialData) -> bool:
    try:
        check_velocity_layers(data)
    except MissingDataError:
        return False
    return True


def trajectory(data: SpatialData, root=None, k: int = 15) -> tuple[str, DataFrame]:
    """(method, (obs_id, ...)): norm and confidence of the velocity where the layers allow it and no ``root`` is given, else diffusion pseudotime from ``root``."""
    data, _, _ = compute_embeddings(data, ("neighbors",), k=k)
    graph = data.graphs[graph_key("neighbors", k=k)]
    if root is None:
        if not has_velocity(data):
            raise ParameterError("without velocity layers a root is needed")
        layers = data.layer("spliced").withColumnRenamed("value", "spliced").join(data.layer("unspliced").withColumnRenamed("value", "unspliced"), ["obs_id", "gene_id"], "full").na.fill(0.0, ["spliced", "unspliced"])
        v = cut(dynamics.velocity(dynamics.moments(layers, graph)))
        return "velocity", dynamics.velocity_norm(v).join(dynamics.velocity_confidence(v, graph), "obs_id", "left")
    return "diffusion", embedding.pseudotime(embedding.diffusion_map(graph), root)


def cached(spark: SparkSession, name: str, parameters: dict, make) -> DataFrame:
    """What ``make()`` returns, written once under its name and parameters in the shared folder and read again from there."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/cache/{name}-{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def converged(history: list[float], window: int = 50, tolerance: float = 1e-3) -> bool:
    """Whether the mean relative change over the last ``window`` values is under ``tolerance``; False while there are fewer."""
    last = history[-window - 1 :]
    if len(last) < window + 1:
        return False
    return sum(abs(b - a) / max(abs(a), 1e-12) for a, b in zip(last, last[1:], strict=False)) / window < tolerance


def writable(spark: SparkSession, path: str) -> str:
    """``path``, if a file can be written there, else a folder of the same name in the shared folder."""
    import uuid

    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        probe = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.probe-{uuid.uuid4().hex}")
        fs.create(probe).close()
        fs.delete(probe, False)
        return path
    except Exception as e:  # whatever the store's driver raises through the gateway
        if "Py4J" not in type(e).__name__:
            raise
        return f"{shared_dir(spark)}/{path.rstrip('/').rsplit('/', 1)[-1]}"


def neighbourhood_graph(data: SpatialData, k: int = 6) -> tuple[SpatialData, DataFrame]:
    """The dataset with its spatial kNN graph, made if it is not there, and the graph."""
    data, _, _ = compute_embeddings(data, ("spatial_neighbors",), spatial_k=k)
    return data, data.graphs[graph_key("spatial", k=k)]


def spatial_statistics(data: SpatialData, genes: DataFrame, k: int = 6) -> DataFrame:
    """Moran's I of chosen genes over the dataset's spatial graph."""
    data, graph = neighbourhood_graph(data, k)
    values = preprocess.densify(data.layer(resolve_layer(data, complete_genes=False)).join(genes.select("gene_id"), "gene_id", "left_semi"), data.obs, genes)
    return spatial.morans_i(graph, values)
