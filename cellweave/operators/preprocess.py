"""Quality control, filters, normalisation, variable genes and scaling.

``expr`` is long (obs_id, gene_id, value) and holds non-zeros only; a statistic over observations divides by their
number, which callers pass or which is counted from ``obs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.errors import DataError, ParameterError
from cellweave.functions import stats
from cellweave.storage import cut


def flag_genes(genes: DataFrame) -> DataFrame:
    """Adds mt and ribo by the prefixes of gene_id as text."""
    name = F.col("gene_id").cast("string")
    return genes.withColumns({"mt": name.rlike("^(MT-|mt-)"), "ribo": name.rlike("^(RPS|RPL|Rps|Rpl)")})


def qc_per_cell(expr: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(obs_id, n_genes, total, log1p_n_genes, log1p_total[, total_mt, pct_mt, total_ribo, pct_ribo]); cells without counts have no row."""
    aggs = [F.count_if(F.col("value") > 0).alias("n_genes"), F.sum("value").alias("total")]
    if genes is not None:
        expr = expr.join(genes.select("gene_id", "mt", "ribo"), "gene_id", "left")
        aggs += [F.sum(F.when(F.col(f), F.col("value")).otherwise(0.0)).alias(f"total_{f}") for f in ("mt", "ribo")]
    out = expr.groupBy("obs_id").agg(*aggs)
    out = out.withColumns({"log1p_n_genes": F.log1p(F.col("n_genes").cast("double")), "log1p_total": F.log1p("total")})
    if genes is not None:
        out = out.withColumns({f"pct_{f}": F.when(F.col("total") > 0, 100.0 * F.col(f"total_{f}") / F.col("total")).otherwise(0.0) for f in ("mt", "ribo")})
    return out


def qc_per_gene(expr: DataFrame, n_obs: int | Column) -> DataFrame:
    """(gene_id, n_cells, total, mean, pct_dropout) over all ``n_obs`` observations."""
    n = F.lit(n_obs) if isinstance(n_obs, int) else n_obs
    g = expr.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("total"))
    return g.withColumns({"mean": F.col("total") / n, "pct_dropout": 100.0 * (1.0 - F.col("n_cells") / n)})


def top_tiers(n_genes: int) -> list[int]:
    """How many top genes to take shares of: 50, 100, 200, 500 where there are more genes; else tenths; always all but one."""
    tiers = [t for t in (50, 100, 200, 500) if t < n_genes] or [max(1, int(n_genes * s)) for s in (0.1, 0.25, 0.5)]
    return sorted({*tiers, max(1, n_genes - 1)})


def top_share(expr: DataFrame, tiers: list[int]) -> DataFrame:
    """(obs_id, top, pct): percentage of a cell's counts in its ``top`` most expressed genes, ties to the smaller gene."""
    w = Window.partitionBy("obs_id").orderBy(F.col("value").desc(), "gene_id")
    ranked = expr.withColumn("r", F.row_number().over(w))
    wide = ranked.groupBy("obs_id").agg(F.sum("value").alias("t"), *[F.sum(F.when(F.col("r") <= n, F.col("value")).otherwise(0.0)).alias(str(n)) for n in tiers])
    return wide.select("obs_id", F.explode(F.array(*[F.struct(F.lit(n).alias("top"), (100.0 * F.col(str(n)) / F.col("t")).alias("pct")) for n in tiers])).alias("s")).select("obs_id", "s.top", "s.pct")


def qc_summary(cells: DataFrame) -> DataFrame:
    """One row of medians and the largest mitochondrial share, from ``qc_per_cell``."""
    return cells.agg(F.count("*").alias("n_cells"), F.median("n_genes").alias("median_genes"), F.median("total").alias("median_total"), F.median("pct_mt").alias("median_pct_mt"), F.max("pct_mt").alias("max_pct_mt"))


def filter_genes(expr: DataFrame, min_cells: int = 3) -> DataFrame:
    keep = expr.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    return expr.join(keep, "gene_id", "left_semi")


def filter_cells(expr: DataFrame, min_genes: int = 30) -> DataFrame:
    keep = expr.where("value > 0").groupBy("obs_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_genes)
    return expr.join(keep, "obs_id", "left_semi")


def filter_mito(expr: DataFrame, cells: DataFrame, max_pct: float = 20.0) -> DataFrame:
    """Drops the cells of ``qc_per_cell`` above ``max_pct``; the share is that before any filter."""
    return expr.join(cells.where(F.col("pct_mt") > max_pct).select("obs_id"), "obs_id", "left_anti")


def subsample(obs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same on every run: the smallest hashes of (seed, obs_id)."""
    return obs.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "obs_id")), "obs_id").limit(n)


def require_counts(expr: DataFrame) -> None:
    """Raises unless every value is a non-negative integer (checked over all values)."""
    off, low = expr.agg(F.max(F.abs(F.col("value") - F.round("value"))), F.min("value")).first()
    if off is not None and (off > 1e-6 or low < 0):
        raise DataError("raw integer counts are required")


def reject_raw(expr: DataFrame) -> None:
    """Raises for data that look like raw counts: no negatives and values above 100."""
    low, high = expr.agg(F.min("value"), F.max("value")).first()
    if low is not None and low >= 0 and high > 100:
        raise DataError("values look like raw counts; normalise first")


def normalise(expr: DataFrame, target: float | None = None, log: bool = True) -> DataFrame:
    """value * target / total of the cell, then ln(1 + x); the target is by default the median of the totals."""
    totals = expr.groupBy("obs_id").agg(F.sum("value").alias("_t"))
    goal = totals.agg(F.median("_t").alias("_m")) if target is None else None
    x = expr.join(totals, "obs_id")
    x = x.join(F.broadcast(goal)) if goal is not None else x.withColumn("_m", F.lit(float(target)))
    v = F.when(F.col("_t") > 0, F.col("value") * F.col("_m") / F.col("_t")).otherwise(0.0)
    return x.select("obs_id", "gene_id", (F.log1p(v) if log else v).alias("value"))


def densify(expr: DataFrame, obs: DataFrame, genes: DataFrame) -> DataFrame:
    """Every (obs, gene) of two key tables, zeros filled: for a chosen set of genes (broadcast when its counted size is small)."""
    few = genes.select("gene_id").distinct()
    side = F.broadcast(few) if few.count() <= 20_000 else few
    return obs.select("obs_id").join(side).join(expr, ["obs_id", "gene_id"], "left").na.fill(0.0, ["value"])


#: Observations and genes of a block, about, and the most tasks, of a table that is made where it is used.
OBS_BLOCK, GENE_BLOCK, BLOCK_TASKS = 8192, 256, 2000


def dense_map(expr: DataFrame, obs: DataFrame, genes: DataFrame, name: str, fn) -> DataFrame:
    """(obs_id, gene_id, ``name``) of every observation with every gene, by ``fn(values, obs, genes)`` in numpy.

    obs: (obs_id, numbers ...), genes: (gene_id, numbers ...), each id once; ``fn`` gets the values of some genes (a row each, zeros
    filled) and both sides' numbers as arrays by name, genes as a column. Only entries and numbers are shuffled: a task takes a
    block of genes with one of observations and makes their rows as it goes. The observations' numbers are broadcast.
    """
    import numpy as np
    import pandas as pd

    obs, genes = cut(obs), cut(genes)
    spark, kinds = expr.sparkSession, {**dict(obs.dtypes), **dict(genes.dtypes)}
    of = [c for c in obs.columns if c != "obs_id"], [c for c in genes.columns if c != "gene_id"]
    parts = [max(1, -(-n // size)) for n, size in ((obs.count(), OBS_BLOCK), (genes.count(), GENE_BLOCK))]
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(parts[k])).cast("int")
    packed = lambda rows, key, k, side: rows.groupBy(block(key, k).alias(side)).agg(*[F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) if c != key else c).alias(c) for c in rows.columns])
    entries = expr.where("obs_id is not null and gene_id is not null and value is not null").groupBy(block("gene_id", 1).alias("gb"), block("obs_id", 0).alias("ob"))
    entries = entries.agg(F.collect_list("gene_id").alias("at_gene"), F.collect_list("obs_id").alias("at_obs"), F.collect_list(F.col("value").cast("double")).alias("value"))
    pairs = packed(genes, "gene_id", 1, "gb").join(spark.range(parts[0]).select(F.col("id").cast("int").alias("ob"))).join(entries, ["gb", "ob"], "left")
    pairs = pairs.repartition(min(parts[0] * parts[1], BLOCK_TASKS), "gb", "ob").join(F.broadcast(packed(obs, "obs_id", 0, "ob")), "ob")

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                ids, names = np.asarray(r["obs_id"]), np.asarray(r["gene_id"])
                some = r["value"] is not None
                i = pd.Index(names).get_indexer(r["at_gene"]) if some else np.empty(0, int)
                j = pd.Index(ids).get_indexer(r["at_obs"]) if some else np.empty(0, int)
                value = np.asarray(r["value"], float)[(i >= 0) & (j >= 0)] if some else np.empty(0)
                i, j = i[(i >= 0) & (j >= 0)], j[(i >= 0) & (j >= 0)]
                step = max(1, 131_072 // len(ids))
                for low in range(0, len(names), step):
                    here = (i >= low) & (i < low + step)
                    few = names[low : low + step]
                    v = np.zeros((len(few), len(ids)))
                    v[i[here] - low, j[here]] = value[here]
                    got = fn(v, {c: np.asarray(r[c], float) for c in of[0]}, {c: np.asarray(r[c], float)[low : low + step, None] for c in of[1]})
                    yield pd.DataFrame({"obs_id": np.tile(ids, len(few)), "gene_id": np.repeat(few, len(ids)), name: got.ravel()})

    return pairs.mapInPandas(run, f"obs_id {kinds['obs_id']}, gene_id {kinds['gene_id']}, {name} double")


def pearson_residuals(expr: DataFrame, obs: DataFrame, genes: DataFrame, theta: float = 100.0) -> DataFrame:
    """(obs_id, gene_id, residual) for the genes asked for: (x - mu) / sqrt(mu + mu^2 / theta), clipped at sqrt(N); mu from the totals of all counts."""
    import numpy as np

    expr = cut(expr)
    cells = obs.select("obs_id").distinct().join(expr.groupBy("obs_id").agg(F.sum("value").alias("_r")), "obs_id")
    cols = genes.select("gene_id").distinct().join(expr.groupBy("gene_id").agg(F.sum("value").alias("_c")), "gene_id")
    total, bound = float(expr.agg(F.sum("value")).first()[0] or 0.0), float(np.sqrt(obs.count()))

    def residual(v, o, g):
        mu = o["_r"] * g["_c"] / total
        return np.clip((v - mu) / np.sqrt(mu + mu * mu / theta), -bound, bound)

    return dense_map(expr, cells, cols, "residual", residual)


def gene_dispersion(normalised: DataFrame, n_obs: int, bins: int = 20) -> DataFrame:
    """(gene_id, mean, dispersion, bin, norm_dispersion): log-normalised values are taken back to counts; ln(variance / mean)
    is standardised within ``bins`` equal bins of ln(1 + mean); a gene alone in its bin gets 1."""
    back = normalised.select("gene_id", F.expm1("value").alias("value"))
    m = stats.zero_aware(back, ("gene_id",), F.lit(n_obs), ddof=1)
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    g = m.select("gene_id", F.log1p("mean").alias("mean"), F.when(F.col("var") > 0, F.log(F.col("var") / mean)).alias("dispersion"))
    every = Window.partitionBy(F.lit(0))
    lo, hi = F.min("mean").over(every), F.max("mean").over(every)
    g = g.withColumns({"_lo": lo, "_hi": hi})
    g = g.withColumn("bin", F.least(F.lit(bins), F.floor((F.col("mean") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) + 1).cast("int"))
    w = Window.partitionBy("bin")
    g = g.withColumns({"_a": F.avg("dispersion").over(w), "_s": F.stddev_samp("dispersion").over(w)})
    lone = F.col("_s").isNull() | (F.col("_s") == 0)
    return g.select("gene_id", "mean", "dispersion", "bin", F.when(lone, 1.0).otherwise((F.col("dispersion") - F.col("_a")) / F.col("_s")).alias("norm_dispersion"))


def variable_genes(dispersion: DataFrame, n_top: int, min_mean: float | None = None, max_mean: float | None = None, min_disp: float | None = None, drop: DataFrame | None = None) -> DataFrame:
    """The ``n_top`` genes of highest normalised dispersion (all where there are fewer than 100), ties to the smaller id; ``drop`` unflags genes."""
    if n_top < 1:
        raise ParameterError("n_top must be at least 1")
    g = dispersion.where("norm_dispersion is not null")
    for bound, test in ((min_mean, F.col("mean") >= (min_mean or 0)), (max_mean, F.col("mean") <= (max_mean or 0)), (min_disp, F.col("norm_dispersion") >= (min_disp or 0))):
        g = g.where(test) if bound is not None else g
    top = g.orderBy(F.col("norm_dispersion").desc(), "gene_id").limit(n_top)
    return top.join(drop.select("gene_id"), "gene_id", "left_anti") if drop is not None else top


def variable_genes_by_batch(normalised: DataFrame, batches: DataFrame, n_top: int) -> DataFrame:
    """(gene_id, n_batches, median_disp): genes variable in most batches, then by the median of their normalised dispersion."""
    sizes = batches.groupBy("batch").agg(F.count("*").alias("n_b"))
    back = normalised.join(batches.select("obs_id", "batch"), "obs_id").select("batch", "gene_id", F.expm1("value").alias("value")).join(F.broadcast(sizes), "batch")
    s, q, n = F.sum("value"), F.sum(F.col("value") * F.col("value")), F.first("n_b")
    g = back.groupBy("batch", "gene_id").agg((s / n).alias("mean"), ((q - s * s / n) / (n - 1)).alias("var"))
    g = g.where("var > 0 and mean > 0").withColumns({"dispersion": F.log(F.col("var") / F.col("mean")), "lm": F.log1p("mean")})
    every = Window.partitionBy("batch")
    g = g.withColumns({"_lo": F.min("lm").over(every), "_hi": F.max("lm").over(every)})
    g = g.withColumn("bin", F.least(F.lit(20), F.floor((F.col("lm") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / 20)) + 1).cast("int"))
    w = Window.partitionBy("batch", "bin")
    sd = F.stddev_samp("dispersion").over(w)
    # Rounded, so that the order does not hang on the order of a sum: two genes alone in a bin are always at the same distance.
    g = g.withColumn("nd", F.round(F.when(sd > 0, (F.col("dispersion") - F.avg("dispersion").over(w)) / sd).otherwise(1.0), 9))
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("batch").orderBy(F.col("nd").desc(), "gene_id")))
    return g.groupBy("gene_id").agg(F.count_if(F.col("r") <= n_top).alias("n_batches"), F.median("nd").alias("median_disp")).orderBy(F.col("n_batches").desc(), F.col("median_disp").desc(), "gene_id").limit(n_top)


def scale(dense: DataFrame, max_value: float | None = 10.0) -> DataFrame:
    """Dense (obs_id, gene_id, value) to z-scores per gene (ddof 1; no spread counts as 1), clipped on both sides, no NaN."""
    m = dense.groupBy("gene_id").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.when((F.col("_s") > 0), F.col("_s")).otherwise(1.0)
    if max_value is not None:
        z = F.greatest(F.lit(-max_value), F.least(F.lit(max_value), z))
    return dense.join(m, "gene_id").select("obs_id", "gene_id", F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)).alias("value"))


def gene_cv(expr: DataFrame, n_obs: int) -> DataFrame:
    """(gene_id, mean, cv): standard deviation over |mean|, 0 where |mean| <= 1e-10."""
    m = stats.zero_aware(expr, ("gene_id",), F.lit(n_obs))
    return m.select("gene_id", "mean", F.when(F.abs("mean") > 1e-10, F.sqrt("var") / F.abs("mean")).otherwise(0.0).alias("cv"))


def pipeline(expr: DataFrame, genes: DataFrame, min_cells: int = 3, min_genes: int = 30, max_mito: float = 20.0, n_hvg: int = 2000, sample_cells: int | None = None, sample_genes: int | None = None, doublets: bool = False, scaled: bool = False, normalisation: str = "log") -> dict[str, DataFrame]:
    """Quality control, filters, snapshot, subsample, doublets, normalisation, variable genes and scaling in the fixed order.

    Returns qc, raw (what the filters left: the snapshot), counts, normalised and hvg; with ``doublets`` their scores, taken out
    of counts; with ``scaled`` the variable genes' z-scores. ``sample_genes`` keeps that many variable genes in counts.
    Normalisation is log, pearson (residuals of the variable genes) or none.
    """
    if normalisation not in ("log", "pearson", "none"):
        raise ParameterError(f"unknown normalisation {normalisation}")
    qc = qc_per_cell(expr, genes)
    raw = counts = cut(filter_mito(filter_cells(filter_genes(expr, min_cells), min_genes), qc, max_mito))
    if sample_cells is not None:
        counts = counts.join(subsample(counts.select("obs_id").distinct(), sample_cells), "obs_id", "left_semi")
    out = {"qc": qc, "raw": raw}
    if doublets:
        out["doublets"] = cut(doublet_scores(counts, counts.select("obs_id").distinct()))
        counts = counts.join(out["doublets"].where("doublet").select("obs_id"), "obs_id", "left_anti")
    counts = cut(counts)
    obs = cut(counts.select("obs_id").distinct())
    logged = counts if normalisation == "none" else normalise(counts)
    hvg = cut(variable_genes(gene_dispersion(logged, obs.count()), min(n_hvg, sample_genes) if sample_genes else n_hvg))
    if sample_genes:
        counts, logged = (x.join(hvg.select("gene_id"), "gene_id", "left_semi") for x in (counts, logged))
    if normalisation == "pearson":
        logged = pearson_residuals(counts, obs, hvg).withColumnRenamed("residual", "value")
    out |= {"counts": counts, "normalised": logged, "hvg": hvg}
    if scaled:
        out["scaled"] = scale(densify(logged.join(hvg.select("gene_id"), "gene_id", "left_semi"), obs, hvg))
    return out


def spatial_gene_filter(expr: DataFrame, n_obs: int, min_share: float = 0.1, min_total: float = 10.0) -> DataFrame:
    """(gene_id, n_expressed, total) of genes expressed in enough observations and often enough for a spatial test."""
    g = expr.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_expressed"), F.sum("value").alias("total"))
    return g.where((F.col("n_expressed") >= F.ceil(F.lit(n_obs * min_share))) & (F.col("total") >= min_total))


def simulate_doublets(expr: DataFrame, obs: DataFrame, ratio: float = 2.0, seed: int = 0) -> DataFrame:
    """(obs_id, gene_id, value) of simulated doublets (negative ids): sums of two cells paired by hash.

    Cells are numbered by the order of a hash, one bucket of it a task; ids are integers.
    """
    n = obs.count()
    total = int(n * ratio)
    buckets = max(1, -(-n // 100_000))
    placed = obs.select("obs_id", F.pmod(F.xxhash64("obs_id"), F.lit(buckets)).alias("bucket"))
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("obs_id"), "obs_id")) - 1)
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size"))
    before = sizes.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("before"))  # a row per bucket
    place = placed.join(F.broadcast(before), "bucket").select("obs_id", (F.col("before") + F.col("at")).alias("place"))
    sims = obs.sparkSession.range(total).select((-F.col("id") - 1).alias("sim"), F.explode(F.array(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n)))).alias("place"))
    return sims.join(place, "place").join(expr, "obs_id").groupBy(F.col("sim").alias("obs_id"), "gene_id").agg(F.sum("value").alias("value"))


def doublet_scores(expr: DataFrame, obs: DataFrame, ratio: float = 2.0, rate: float = 0.06, k: int | None = None, n_genes: int = 500, n_components: int = 30, seed: int = 0) -> DataFrame:
    """(obs_id, score, doublet): by how many simulated doublets stand among the nearest of a cell and of them.

    Cells and simulated doublets are normalised together, reduced to variable genes and principal components; of the share f of
    doublets among k neighbours the score is rate f / ratio / ((1 - rate)(1 - f) + rate f / ratio). A cell is called a doublet
    over the ``rate``-th highest score. Fewer than 100 cells: score 0, no doublet.
    """
    from cellweave.operators import embedding, neighbors

    n = obs.count()
    if n < 100:
        return obs.select("obs_id", F.lit(0.0).alias("score"), F.lit(False).alias("doublet"))
    both = cut(normalise(expr.select("obs_id", "gene_id", "value").unionByName(simulate_doublets(expr, obs, ratio, seed))))
    everyone = both.select("obs_id").distinct()
    genes = cut(variable_genes(gene_dispersion(both.where("obs_id >= 0"), n), n_genes).select("gene_id"))
    dense = densify(both.join(F.broadcast(genes), "gene_id", "left_semi"), everyone, genes)
    scores, _, _ = embedding.pca(embedding.to_vectors(dense), n_components)
    k = k or max(5, round(0.5 * n**0.5))
    near = neighbors.vector_knn(cut(scores), int(k * (1 + ratio)))
    f = near.where("src >= 0").groupBy(F.col("src").alias("obs_id")).agg((F.count_if(F.col("dst") < 0) + 1.0).alias("m"), F.count("*").alias("k"))
    share = F.col("m") / (F.col("k") + 2.0)
    s = cut(f.select("obs_id", (rate * share / ratio / ((1 - rate) * (1 - share) + rate * share / ratio)).alias("score")))
    bar = s.agg(F.percentile("score", F.lit(1 - rate)).alias("bar"))
    return s.join(F.broadcast(bar)).select("obs_id", "score", (F.col("score") > F.col("bar")).alias("doublet"))
