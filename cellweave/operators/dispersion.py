"""Negative-binomial dispersions of pseudobulk genes: by gene, as a trend over the mean, and shrunk towards it.

A gene's own dispersion maximises the profile likelihood of its counts, adjusted for the two coefficients of the design.
The trend a1 / mean + a0 is a gamma regression with identity link, by weighted sums over all genes; genes far off the
trend are left out of the next round. The spread of log dispersions round the trend, less what sampling alone gives, is
the variance of a prior, under which each gene is fitted again. Genes far above the trend keep their own dispersion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import stats
from cellweave.storage import cut

LEAST, ROUNDS = 1e-8, 10
#: Shares of the trend between which a gene takes part in the next round of it; the least variance of the prior; how many
#: standard deviations above the trend a gene keeps its own dispersion.
BAND, LEAST_PRIOR, OUTLYING = (1e-4, 15.0), 0.25, 2.0


def trigamma(x: Column) -> Column:
    """For x > 0: twelve steps up, then the asymptotic series."""
    far = x + 12
    z = 1 / (far * far)
    return sum((1 / ((x + k) * (x + k)) for k in range(12)), F.lit(0.0)) + 1 / far + z / 2 + z / far * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))


def _beside(rows: DataFrame, sets: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``rows`` with what is known of their set; a row per set."""
    return rows.join(F.broadcast(sets), list(by) if by else F.lit(True), how)


def trend(points: DataFrame, by: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """(*by, a0, a1) of ``points`` (*by, mean, dispersion): dispersion = a1 / mean + a0, no coefficient below zero.

    Round one weighs a gene by the inverse square of its dispersion, each later one by that of the trend before. Genes whose mean is not
    positive or whose dispersion is not above ``100 LEAST`` take no part; fewer than two leave no trend for their set.
    """
    p = points.where((F.col("mean") > 0) & (F.col("dispersion") > 100 * LEAST)).select(*by, (1.0 / F.col("mean")).alias("_x"), F.col("dispersion").alias("_y"))
    p = cut(p)
    fitted = None
    for _ in range(rounds):
        step = p.withColumn("_w", 1.0 / (F.col("_y") * F.col("_y")))
        if fitted is not None:
            on = F.greatest(F.col("a1") * F.col("_x") + F.col("a0"), F.lit(LEAST))
            step = _beside(p, fitted, by).withColumn("_fit", on)
            step = step.where((F.col("_y") / F.col("_fit") > BAND[0]) & (F.col("_y") / F.col("_fit") < BAND[1])).withColumn("_w", 1.0 / (F.col("_fit") * F.col("_fit")))
        w, x, y = F.col("_w"), F.col("_x"), F.col("_y")
        sums = step.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(w).alias("_s"), F.sum(w * x).alias("_sx"), F.sum(w * x * x).alias("_sxx"), F.sum(w * y).alias("_sy"), F.sum(w * x * y).alias("_sxy"))
        det = F.col("_s") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
        slope = F.when(det > 1e-12 * F.col("_s") * F.col("_sxx"), (F.col("_s") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / det).otherwise(0.0)
        flat = F.col("_sy") / F.col("_s")
        level = flat - F.col("_slope") * F.col("_sx") / F.col("_s")
        sums = sums.where("_n > 1").withColumn("_slope", slope).withColumn("_level", level)
        # A coefficient below zero is zero, and the other is fitted alone.
        a1 = F.when(F.col("_slope") < 0, 0.0).when(F.col("_level") < 0, F.col("_sxy") / F.col("_sxx")).otherwise(F.col("_slope"))
        a0 = F.when(F.col("_slope") < 0, flat).when(F.col("_level") < 0, 0.0).otherwise(F.col("_level"))
        fitted = sums.select(*by, a0.alias("a0"), a1.alias("a1"))
    return fitted


def _rising(v, r):
    """lgamma(v + r) - lgamma(r) by elements: eight steps up, then the difference of Stirling's series."""
    import numpy as np

    z, steps = r + 8, np.ones(np.broadcast_shapes(v.shape, r.shape))
    for k in range(8):
        steps = steps * (1 + v / (r + k))
    rest = lambda x: (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return (z - 0.5) * np.log1p(v / z) + v * np.log(z + v) - v + rest(z + v) - rest(z) - np.log(steps)


def _sides(w, first, ridge: float):
    """(sum of w, its part in the first condition, determinant) of the design's information, ``ridge`` on its diagonal; by rows."""
    a, b = w.sum(axis=1), (w * first).sum(axis=1)
    return a, b, b * (a - b) + ridge * (a + b) + ridge * ridge


def likelihoods(y, mu, alpha, first):
    """By rows (a gene each): log likelihood of counts with means ``mu``, less half the log determinant of the coefficients' information."""
    import numpy as np

    alpha = alpha[:, None]
    spread = alpha * mu
    terms = _rising(y, 1 / alpha) + y * np.log(spread) - (y + 1 / alpha) * np.log1p(spread)
    return terms.sum(axis=1) - 0.5 * np.log(_sides(mu / (1 + spread), first, 1e-12)[2])


def _likelihood(y, mu, alpha: float, design) -> float:
    import numpy as np

    return float(likelihoods(y[None], mu[None], np.array([alpha]), design[None, :, 1])[0])


def best_dispersions(y, mu, first, centre=None, variance=None):
    """By rows: dispersion of greatest adjusted likelihood, with a normal prior on its log round ``centre`` if that is given."""
    import numpy as np

    def value(log_alpha):
        found = likelihoods(y, mu, np.exp(log_alpha), first)
        return found if centre is None else found - (log_alpha - np.log(centre)) ** 2 / (2 * variance)

    n = len(y)
    steps = np.linspace(math.log(LEAST), math.log(max(10.0, y.shape[1])), 25)
    k = np.argmax([value(np.full(n, s)) for s in steps], axis=0)
    low, high, golden = steps[np.maximum(0, k - 1)], steps[np.minimum(24, k + 1)], (math.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = value(a), value(b)
    while (open_ := high - low > 1e-6).any():
        left, right = open_ & (fa > fb), open_ & ~(fa > fb)
        high, low = np.where(left, b, high), np.where(right, a, low)
        at = np.where(left, high - golden * (high - low), low + golden * (high - low))
        got = value(at)
        a, b, fa, fb = np.where(left, at, np.where(right, b, a)), np.where(left, a, np.where(right, at, b)), np.where(left, got, np.where(right, fb, fa)), np.where(left, fa, np.where(right, got, fb))
    return np.exp((low + high) / 2)


def best_dispersion(y, mu, design, centre: float | None = None, variance: float = 1.0) -> float:
    import numpy as np

    return float(best_dispersions(y[None], mu[None], design[None, :, 1], None if centre is None else np.array([centre]), np.array([variance]))[0])


def fitted_means(y, s, first, alpha):
    """By rows: (coefficient of the first condition, means, its variance) of the log-linear model with size factors ``s``, by reweighted least squares."""
    import numpy as np

    n = len(y)
    beta = np.stack([np.log(np.maximum((y / s).mean(axis=1), 1e-8)), np.zeros(n)], axis=1)
    means, spread, todo = np.empty(y.shape), np.empty(n), np.arange(n)
    for _ in range(50):
        f, own = first[todo], beta[todo]
        mu = np.maximum(s[todo] * np.exp(np.clip(own[:, :1] + f * own[:, 1:], -30, 30)), 1e-8)
        w = mu / (1 + alpha[todo, None] * mu)
        a, b, det = _sides(w, f, 1e-6)
        off = w * (y[todo] - mu) / mu
        p, q = off.sum(axis=1) - 1e-6 * own[:, 0], (off * f).sum(axis=1) - 1e-6 * own[:, 1]
        step = np.stack([((b + 1e-6) * p - b * q) / det, ((a + 1e-6) * q - b * p) / det], axis=1)
        beta[todo] += np.clip(step, -5, 5)
        means[todo], spread[todo] = mu, (a + 1e-6) / det
        todo = todo[np.abs(step).max(axis=1) >= 1e-8]
        if not len(todo):
            break
    return beta[:, 1], means, spread


def rough_dispersions(q, s, first):
    """By rows: from the variance within the conditions, beyond that of counts."""
    import numpy as np

    over = under = np.zeros(len(q))
    for side in (1 - first, first):
        n = side.sum(axis=1)
        many = np.maximum(n, 2)
        m = (q * side).sum(axis=1) / many
        squares = (side * (q - m[:, None]) ** 2).sum(axis=1)
        over = over + np.where(n > 1, squares - (n - 1) * m * (side / s).sum(axis=1) / many, 0.0)
        under = under + np.where(n > 1, (n - 1) * m**2, 0.0)
    return np.where(under > 0, np.maximum(LEAST, over / np.where(under > 0, under, 1.0)), 1.0)


def _packed(bulk: DataFrame, factors: DataFrame, a, b, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """((*by, gene_id, at, value): a row for each gene, its counts of both conditions as arrays with their places among the
    samples of the set; (*by, size_factor, first, sides): those samples, a row for each set)."""
    x = bulk.where(F.col("condition").isin(a, b))
    samples = x.select(*by, "sample", "condition").distinct().join(factors, [*by, "sample"])
    sets = samples.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("sample", "condition", "size_factor"))).alias("of"))  # samples are few
    sets = cut(sets)
    placed = sets.select(*by, F.posexplode("of").alias("at", "one")).select(*by, "at", F.col("one.sample").alias("sample"), F.col("one.condition").alias("condition"))
    counts = x.join(F.broadcast(placed), [*by, "sample", "condition"]).select(*by, "gene_id", "at", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    genes = counts.repartition(counts.sparkSession.sparkContext.defaultParallelism * 4, *by, "gene_id").groupBy(*by, "gene_id").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))
    first = F.transform("of", lambda r: F.when(r["condition"] == a, 1.0).otherwise(0.0))
    sides = F.size(F.array_distinct(F.col("of.condition")))
    return cut(genes), sets.select(*by, F.col("of.size_factor").alias("size_factor"), first.alias("first"), sides.alias("sides"))


def _by_genes(rows: DataFrame, by: tuple[str, ...], columns: str, fn) -> DataFrame:
    """Applies ``fn(y, s, first, rows)`` to batches of genes: arrays of a row for each gene and a column for each sample, zeros filled."""
    import pandas as pd

    kinds = dict(rows.dtypes)
    keys = [*by, "gene_id"]
    names = [*keys, *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        import numpy as np

        for batch in batches:
            for size, g in batch.groupby(batch["size_factor"].map(len)):
                y = np.zeros((len(g), size))
                np.add.at(y, (np.repeat(np.arange(len(g)), g["at"].map(len)), np.concatenate(g["at"].to_numpy())), np.concatenate(g["value"].to_numpy()))
                got = fn(y, np.stack(g["size_factor"].to_numpy()), np.stack(g["first"].to_numpy()), g)
                yield pd.DataFrame({**{k: g[k].to_numpy() for k in keys}, **dict(zip(names[len(keys) :], got, strict=True))})

    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), columns]))


def dispersions(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, gene_id, mean, dispersion): each gene's own dispersion; rows are those of ``_packed`` beside their sets. Genes without a count are left out."""

    def own(y, s, first, _):
        import numpy as np

        q = y / s
        mean, alpha, some = q.mean(axis=1), np.full(len(y), LEAST), q.sum(axis=1) > 0
        if some.any():
            y, s, first = y[some], s[some], first[some]
            alpha[some] = best_dispersions(y, fitted_means(y, s, first, rough_dispersions(q[some], s, first))[1], first)
        return np.where(some, mean, 0.0), alpha

    return _by_genes(rows, by, "mean double, dispersion double", own)


def prior(own: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, a0, a1, spread, variance) of ``fitted`` (*by, a0, a1, free): the robust variance of log dispersions round the trend,
    and what of it sampling with ``free`` degrees of freedom does not explain."""
    x = _beside(own.where((F.col("mean") > 0) & (F.col("dispersion") > 100 * LEAST)), fitted, by)
    x = x.withColumn("r", F.log(F.col("dispersion") / F.greatest(F.col("a1") / F.col("mean") + F.col("a0"), F.lit(LEAST))))
    off = _beside(x, x.groupBy(*by).agg(F.median("r").alias("m")), by).withColumn("off", F.abs(F.col("r") - F.col("m")))
    spread = off.groupBy(*by, "a0", "a1", "free").agg((1.4826 * F.median("off")).alias("sd")).withColumn("spread", F.col("sd") * F.col("sd"))
    sampling = F.when(F.col("free") > 0, trigamma(F.col("free") / 2)).otherwise(0.0)
    return spread.select(*by, "a0", "a1", "spread", F.greatest(F.lit(LEAST_PRIOR), F.col("spread") - sampling).alias("variance"))


def wald(bulk: DataFrame, factors: DataFrame, a, b, by: tuple[str, ...] = (), shrink: bool = True) -> DataFrame:
    """(*by, gene_id, base_mean, dispersion, log2fc, se, p, q): two-condition regression of each gene, Wald test, BH within ``by``.

    bulk: (*by, sample, condition, gene_id, value); factors: (*by, sample, size_factor). With ``shrink`` dispersions are
    drawn to their trend, each set of ``by`` having its own; sets with too few genes for a trend, or one condition, keep
    their own. Genes without a count are left out.
    """
    genes, sets = _packed(bulk, factors, a, b, by)
    rows = _beside(genes, sets, by)
    own = cut(dispersions(rows, by).where("mean > 0"))
    free = sets.where("sides = 2").select(*by, (F.size("first") - 2).cast("double").alias("free"))
    found = own
    if shrink:
        law = cut(prior(own, cut(_beside(trend(own, by), free, by)), by))
        found = _beside(own, law, by, "left")
    else:
        found = own.withColumns({c: F.lit(None).cast("double") for c in ("a0", "a1", "spread", "variance")})
    known = _beside(rows.join(found, [*by, "gene_id"]), free, by)

    def fit(y, s, first, g):
        import numpy as np

        known = {c: g[c].to_numpy(float) for c in ("mean", "dispersion", "a0", "a1", "spread", "variance")}
        alpha, centre = known["dispersion"].copy(), np.maximum(LEAST, known["a1"] / known["mean"] + known["a0"])
        with np.errstate(invalid="ignore"):
            near = np.isfinite(known["variance"]) & (np.log(alpha) <= np.log(centre) + OUTLYING * np.sqrt(known["spread"]))
        if near.any():
            mu = fitted_means(y[near], s[near], first[near], alpha[near])[1]
            alpha[near] = best_dispersions(y[near], mu, first[near], centre[near], known["variance"][near])
        beta, _, spread = fitted_means(y, s, first, alpha)
        return known["mean"], alpha, beta / math.log(2), np.sqrt(spread) / math.log(2)

    out = _by_genes(known, by, "base_mean double, dispersion double, log2fc double, se double", fit)
    return stats.adjust(out.withColumn("p", stats.normal_two_sided(F.col("log2fc") / F.col("se"))), "p", "q", "bh", by, ("gene_id",))
