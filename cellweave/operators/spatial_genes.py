"""Spatially variable genes: covariance with projected coordinates, and Gaussian processes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.errors import DataError
from cellweave.functions import stats

SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)


def projections(coords: DataFrame) -> DataFrame:
    """(obs_id, kernel, a, b): the coordinates centred, and their Gaussian and cosine images at five scales each, centred; 11 kernels.

    Scales are quantiles of the distance of each coordinate from its mean.
    """
    m = coords.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = coords.join(F.broadcast(m)).select("obs_id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    q = c.agg(*[F.percentile(F.abs(v), F.array(*map(F.lit, SHARES))).alias(f"q{v}") for v in ("x", "y")])
    z = c.join(F.broadcast(q))
    kernels = [("projection", F.col("x"), F.col("y"))]
    for i in range(len(SHARES)):
        gauss = lambda v, i=i: F.exp(-F.col(v) * F.col(v) / (2 * F.col(f"q{v}")[i] * F.col(f"q{v}")[i]))
        wave = lambda v, i=i: F.cos(2 * math.pi * F.col(v) / F.col(f"q{v}")[i])
        kernels += [(f"gaussian{i + 1}", gauss("x"), gauss("y")), (f"cosine{i + 1}", wave("x"), wave("y"))]
    rows = z.select("obs_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kernel"), a.alias("a"), b.alias("b")) for k, a, b in kernels])).alias("s")).select("obs_id", "s.*")
    means = rows.groupBy("kernel").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    return rows.join(F.broadcast(means), "kernel").select("obs_id", "kernel", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))


def kernel_test(expr: DataFrame, coords: DataFrame) -> DataFrame:
    """(gene_id, kernel, r2, p): n R^2 of a gene on two centred images is chi-squared with two degrees of freedom, whose tail is exp(-x/2).

    Images are centred, so zeros add nothing to the covariances: only non-zeros meet them.
    """
    z = projections(coords)
    v = z.groupBy("kernel").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    n = coords.agg(F.count("*").alias("n_all"))
    own = expr.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(n)).select("gene_id", (F.col("q") - F.col("s") * F.col("s") / F.col("n_all")).alias("yy"))
    c = expr.join(z, "obs_id").groupBy("gene_id", "kernel").agg(F.sum(F.col("value") * F.col("a")).alias("ya"), F.sum(F.col("value") * F.col("b")).alias("yb"))
    t = c.join(F.broadcast(v), "kernel").join(own, "gene_id").where("yy > 0")
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    r2 = (F.col("ya") * F.col("ya") * F.col("bb") - 2 * F.col("ya") * F.col("yb") * F.col("ab") + F.col("yb") * F.col("yb") * F.col("aa")) / (det * F.col("yy"))
    return t.where(det > 1e-12).select("gene_id", "kernel", r2.alias("r2"), F.exp(-F.col("n") * r2 / 2).alias("p"))


def spatially_variable(expr: DataFrame, coords: DataFrame) -> DataFrame:
    """(gene_id, p, q): the kernels' p-values by Cauchy combination, corrected after Benjamini and Yekutieli."""
    t = kernel_test(expr, coords).withColumn("p", F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-300), F.col("p"))))
    return stats.adjust(t.groupBy("gene_id").agg(stats.cauchy_combination(F.col("p")).alias("p")), "p", "q", "by", (), ("gene_id",))


def top_genes(tested: DataFrame, n: int | None = None, level: float = 0.05) -> DataFrame:
    out = tested.where(F.col("q") < level).orderBy("q", "gene_id")
    return out.limit(n) if n else out


def housekeeping_warning(tested: DataFrame, pattern: str = "^(RPS|RPL|MT-|ACTB|GAPDH)", n: int = 50) -> bool:
    """Whether over 30 % of the n best genes are housekeeping genes."""
    best = tested.orderBy("q", "gene_id").limit(n)
    return (best.agg(F.avg(F.when(F.col("gene_id").cast("string").rlike(pattern), 1.0).otherwise(0.0))).first()[0] or 0.0) > 0.3


def _waves(scale: float, features: int, seed: int):
    """Frequencies whose cosines and sines have, on average, the squared-exponential kernel of this scale."""
    import numpy as np

    return np.random.default_rng(seed).normal(size=(features // 2, 2)) / scale


def _images(xy, waves):
    import numpy as np

    return np.concatenate([f(xy @ w.T) / np.sqrt(len(w)) for w in waves for f in (np.cos, np.sin)], axis=1)


def variance_share(z2, s, rest: float, m: int) -> tuple[float, float]:
    """(log likelihood gained, ratio of kernel variance to noise) at the best ratio: ``z2`` squared projections of a centred gene
    on the kernel's eigenvectors of values ``s``, ``rest`` its square sum beside them, ``m`` its degrees of freedom."""
    import numpy as np

    def gain(log_ratio: float) -> float:
        grown = 1 + math.exp(log_ratio) * s
        return -0.5 * (m * math.log(max(1e-300, ((z2 / grown).sum() + rest) / (z2.sum() + rest))) + np.log(grown).sum())

    steps = np.linspace(-14, 8, 45)
    values = [gain(t) for t in steps]
    k = int(np.argmax(values))
    low, high, golden = steps[max(0, k - 1)], steps[min(44, k + 1)], (math.sqrt(5) - 1) / 2
    while high - low > 1e-5:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if gain(a) > gain(b) else (a, high)
    best = (low + high) / 2
    return (gain(best), math.exp(best)) if gain(best) > 0 else (0.0, 0.0)


def gaussian_process(expr: DataFrame, coords: DataFrame, scales: int = 5, features: int = 64, seed: int = 0) -> DataFrame:
    """(gene_id, scale, share, gain, p, q): likelihood-ratio test of a Gaussian process over space against noise alone.

    The squared-exponential kernel of each of ``scales`` lengths (from the mean spacing to half of the extent) is taken in a
    basis of ``features`` cosines and sines; its Gram matrix gives the kernel's eigenvectors once, and of a gene only its
    products with the basis are summed, zeros adding nothing. Then each gene's likelihood is profiled over the ratio of kernel
    variance to noise. share: of the variance that is spatial, at the scale of greatest likelihood; p: half of the
    chi-squared tail with one degree of freedom, one where nothing is gained; q after Benjamini and Hochberg.
    """
    import numpy as np
    import pandas as pd

    c = coords.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n, x0, x1, y0, y1 = c.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 3 or max(x1 - x0, y1 - y0) <= 0:
        raise DataError("a Gaussian process needs three observations at different places")
    extent = max(x1 - x0, y1 - y0)
    lengths = np.geomspace(extent / math.sqrt(n), extent / 2, scales)
    waves = [_waves(length, features, seed + k) for k, length in enumerate(lengths)]
    wide = scales * 2 * (features // 2)
    of = lambda g: _images(g[["x", "y"]].to_numpy(float), waves)

    def sums(batches):
        gram, total = np.zeros((wide, wide)), np.zeros(wide)
        for g in batches:
            v = of(g)
            gram, total = gram + v.T @ v, total + v.sum(axis=0)
        yield pd.DataFrame({"g": [gram.tobytes()], "t": [total.tobytes()]})

    def added(batches):
        gram, total = np.zeros(wide * wide), np.zeros(wide)
        for b in batches:
            for g, t in zip(b["g"], b["t"], strict=True):
                gram, total = gram + np.frombuffer(g), total + np.frombuffer(t)
        yield pd.DataFrame({"g": [gram.tobytes()], "t": [total.tobytes()]})

    got = c.select("x", "y").mapInPandas(sums, "g binary, t binary").repartition(8).mapInPandas(added, "g binary, t binary").collect()  # eight small matrices
    mean = sum(np.frombuffer(r["t"]) for r in got) / n
    gram = sum(np.frombuffer(r["g"]) for r in got).reshape(wide, wide) - n * np.outer(mean, mean)
    each = wide // scales
    bases = []
    for k in range(scales):
        s, v = np.linalg.eigh(gram[k * each : (k + 1) * each, k * each : (k + 1) * each])
        keep = s > 1e-9 * n
        bases.append((s[keep], v[:, keep]))
    kind = dict(expr.dtypes)["gene_id"]

    def products(batches):
        for g in batches:
            v, (codes, genes) = of(g) * g["value"].to_numpy(float)[:, None], pd.factorize(g["gene_id"])
            out = np.zeros((len(genes), wide))
            np.add.at(out, codes, v)
            yield pd.DataFrame({"gene_id": genes, "v": [r.tobytes() for r in out], "s": np.bincount(codes, g["value"]), "q": np.bincount(codes, g["value"] ** 2)})

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v, total = sum(np.frombuffer(x) for x in g["v"]), g["s"].sum()
        square = g["q"].sum() - total * total / n
        best = (0.0, 0.0, float(lengths[0]))
        if square > 1e-12 * g["q"].sum():
            v = v - total * mean
            for k, (s, u) in enumerate(bases):
                z2 = (u.T @ v[k * each : (k + 1) * each]) ** 2 / s
                gain, ratio = variance_share(z2, s, max(0.0, square - z2.sum()), n - 1)
                spatial = ratio * s.sum() / (n - 1)
                best = max(best, (gain, spatial / (1 + spatial), float(lengths[k])))
        return pd.DataFrame({"gene_id": [key[0]], "scale": [best[2]], "share": [best[1]], "gain": [best[0]]})

    parts = expr.select("obs_id", "gene_id", F.col("value").cast("double").alias("value")).join(c, "obs_id").mapInPandas(products, f"gene_id {kind}, v binary, s double, q double")
    tested = parts.groupBy("gene_id").applyInPandas(fit, f"gene_id {kind}, scale double, share double, gain double")
    half = stats.normal_two_sided(F.sqrt(2 * F.col("gain"))) / 2
    return stats.adjust(tested.withColumn("p", F.when(F.col("gain") > 0, half).otherwise(1.0)), "p", "q", "bh", (), ("gene_id",))


METHODS = {"kernels": spatially_variable, "gaussian_process": gaussian_process}
