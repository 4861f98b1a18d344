"""Several samples in one space: concatenation, batch graphs, alignment, correction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.errors import DataError, DependencyError
from cellweave.storage import cut


def concatenate(parts: list[DataFrame], names: list[str] | None = None, keep_gene: str = "outer") -> DataFrame:
    """(batch, obs_id, gene_id, value): outer union of genes is free in long form; ``inner`` keeps genes that every part has."""
    if len(parts) < 2:
        raise DataError("at least two datasets are needed")
    tagged = [p.withColumn("batch", F.lit((names or [f"sample_{i}" for i in range(len(parts))])[i])) for i, p in enumerate(parts)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if keep_gene == "inner":
        every = out.groupBy("gene_id").agg(F.countDistinct("batch").alias("n")).where(F.col("n") == len(parts))
        out = out.join(every, "gene_id", "left_semi")
    return out


def common_genes(parts: list[DataFrame]) -> DataFrame:
    """(gene_id) in every table."""
    return reduce(lambda a, b: a.join(b.select("gene_id").distinct(), "gene_id", "left_semi"), parts[1:], parts[0].select("gene_id").distinct())


def batch_balanced_knn(vectors: DataFrame, k: int = 3) -> DataFrame:
    """(src, dst, batch, d, rank): the k nearest of each batch for every obs of (obs_id, v, batch)."""
    from cellweave.operators.neighbors import vector_knn

    return vector_knn(vectors, k, "batch")


def mutual_pairs(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(a, b): mutual nearest neighbours of different batches, a < b."""
    e = batch_balanced_knn(vectors, k)
    own = vectors.select(F.col("obs_id").alias("src"), F.col("batch").alias("own"))
    e = e.join(own, "src").where("own <> batch").select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"]).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def align(coords: DataFrame, reference: str) -> DataFrame:
    """(obs_id, batch, x, y): coordinates as z-scores of the reference batch's mean and population sd; keyed by obs, whatever the row order."""
    r = coords.where(F.col("batch") == reference).agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: ((F.col(c) - F.col(f"m{c}")) / F.when(F.col(f"s{c}") > 0, F.col(f"s{c}")).otherwise(1.0)).alias(c)
    return coords.join(F.broadcast(r)).select("obs_id", "batch", z("x"), z("y"))


def centre_batches(vectors: DataFrame) -> DataFrame:
    """(obs_id, batch, v): each batch moved to the mean of all: the linear step of a soft-cluster correction with one cluster."""
    long = vectors.select("obs_id", "batch", F.posexplode("v").alias("i", "x"))
    m = Window.partitionBy("batch", "i")
    every = Window.partitionBy("i")
    fixed = long.withColumn("x", F.col("x") - F.avg("x").over(m) + F.avg("x").over(every))
    return fixed.groupBy("obs_id", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def harmonise(vectors: DataFrame, clusters: int = 10, rounds: int = 10, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """(obs_id, batch, v): batches are centred, then corrected by soft clusters. Each round: responsibilities per obs (an Arrow kernel over rows), then one
    sum per cluster and batch, which the driver holds (clusters x batches x dimensions numbers), then the shift of each obs."""
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    v = cut(centre_batches(vectors))
    first = v.orderBy(F.xxhash64("obs_id", F.lit(seed)), "obs_id").limit(clusters).collect()
    centres = np.array([r["v"] for r in first], float)
    batches = sorted(r[0] for r in v.select("batch").distinct().collect())
    shift = np.zeros((len(centres), len(batches), centres.shape[1]))
    schema = v.schema

    def shares(x, c):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        w = np.exp(-(d - d.min(axis=1, keepdims=True)) / max(d.mean() / 4, 1e-12))
        return w / w.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        c, s = centres, shift

        def sums(batches_it, c=c, s=s):
            for b in batches_it:
                x, at = np.stack(b["v"].to_numpy()), np.array([batches.index(g) for g in b["batch"]])
                r = shares(x - 0, c)
                for k in range(len(c)):
                    for j in np.unique(at):
                        m = at == j
                        yield pd.DataFrame({"k": [k], "j": [int(j)], "n": [float(r[m, k].sum())], "v": [(r[m, k, None] * x[m]).sum(axis=0).tolist()]})

        part = v.mapInPandas(sums, "k int, j int, n double, v array<double>").select("k", "j", "n", F.posexplode("v").alias("i", "x")).groupBy("k", "j", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        n, t = np.zeros(shift.shape), np.zeros(shift.shape)
        for r in part:
            n[r["k"], r["j"], r["i"]], t[r["k"], r["j"], r["i"]] = r["n"], r["x"]
        new = t.sum(axis=1) / np.maximum(n.sum(axis=1), 1e-12)
        shift = (t - n * new[:, None]) / (n + ridge)
        if np.abs(new - centres).max() < 1e-6:
            break
        centres = new

    def fixed(it, c=centres, s=shift):
        for b in it:
            x, at = np.stack(b["v"].to_numpy()), np.array([batches.index(g) for g in b["batch"]])
            r = shares(x, c)
            yield b.assign(v=list(x - np.einsum("nk,nkd->nd", r, s[:, at].transpose(1, 0, 2))))

    return v.mapInPandas(fixed, schema)


def variational(*_, **__):
    raise DependencyError("variational autoencoders need torch; use harmonise or centre_batches")
