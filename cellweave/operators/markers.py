"""Markers between groups, pseudobulk and condition comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.errors import DataError, ParameterError
from cellweave.functions import stats
from cellweave.operators import dispersion
from cellweave.storage import cut


def _sizes(groups: DataFrame) -> DataFrame:
    every = groups.agg(F.count("*").alias("n_all"))
    return groups.groupBy("group").agg(F.count("*").alias("n1")).join(F.broadcast(every)).withColumn("n2", F.col("n_all") - F.col("n1"))


def large_groups(groups: DataFrame, min_cells: int = 3) -> DataFrame:
    """``groups`` (obs_id, group) without the groups of fewer than ``min_cells`` cells."""
    keep = groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    return groups.join(F.broadcast(keep), "group", "left_semi")


def group_moments(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene_id, group, n1, n2, m1, v1, m2, v2): means and variances (ddof 1) of each group and of the rest, zeros included."""
    x = expr.join(groups.select("obs_id", "group"), "obs_id")
    g = x.groupBy("gene_id", "group").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("q1"))
    tot = g.groupBy("gene_id").agg(F.sum("s1").alias("s"), F.sum("q1").alias("q"))
    all_pairs = tot.join(F.broadcast(_sizes(groups))).join(g, ["gene_id", "group"], "left").na.fill(0.0, ["s1", "q1"])
    n1, n2, s1, q1 = F.col("n1"), F.col("n2"), F.col("s1"), F.col("q1")
    s2, q2 = F.col("s") - s1, F.col("q") - q1
    return all_pairs.select(
        "gene_id", "group", "n1", "n2",
        (s1 / n1).alias("m1"), F.when(n1 > 1, F.greatest(F.lit(0.0), (q1 - s1 * s1 / n1) / (n1 - 1))).alias("v1"),
        F.when(n2 > 0, s2 / n2).alias("m2"), F.when(n2 > 1, F.greatest(F.lit(0.0), (q2 - s2 * s2 / n2) / (n2 - 1))).alias("v2"),
    )


def t_test(expr: DataFrame, groups: DataFrame, overestimate: bool = False) -> DataFrame:
    """(gene_id, group, t, df, p, q): Welch's t of each group against the rest, two-sided p, BH within the group.

    ``overestimate`` divides the rest's variance by the group's size.
    """
    m = group_moments(expr, groups)
    b = F.col("n1") if overestimate else F.col("n2")
    a1, a2 = F.col("v1") / F.col("n1"), F.col("v2") / b
    df = (a1 + a2) * (a1 + a2) / (a1 * a1 / (F.col("n1") - 1) + a2 * a2 / (b - 1))
    out = m.where(a1 + a2 > 0).select("gene_id", "group", ((F.col("m1") - F.col("m2")) / F.sqrt(a1 + a2)).alias("t"), df.alias("df"))
    return stats.adjust(stats.student_two_sided(out), "p", "q", "bh", ("group",), ("gene_id",))


def in_groups(groups: DataFrame, chosen: list) -> DataFrame:
    """The observations of the groups asked for; an error names those that no observation has."""
    have = {r[0] for r in groups.select("group").distinct().where(F.col("group").isin(chosen)).collect()}
    if missing := [g for g in chosen if g not in have]:
        raise ParameterError(f"no observation is in group {', '.join(map(str, missing))}")
    return groups.where(F.col("group").isin(chosen))


def pairwise(expr: DataFrame, groups: DataFrame, first, second=None, test=None) -> DataFrame:
    """``test`` (by default ``wilcoxon``) of group ``first`` against ``second``, or against all other cells where that is None."""
    chosen = in_groups(groups, [first] if second is None else [first, second])
    used = groups if second is None else chosen
    inside = expr.join(used.select("obs_id"), "obs_id", "left_semi")
    return (test or wilcoxon)(inside, used).where(F.col("group") == first)


def wilcoxon(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene_id, group, z, p, q): rank-sum of each group against the rest, without tie correction, BH within the group.

    Values are non-negative, so a gene's zeros are one tie block at the bottom: only non-zeros are ranked and the block
    is added by arithmetic.
    """
    x = expr.where("value > 0").join(groups.select("obs_id", "group"), "obs_id").select("gene_id", "group", "value")
    sizes = _sizes(groups)
    w = Window.partitionBy("gene_id")
    ranked = x.withColumn("r", stats.average_rank("value", ("gene_id",))).withColumn("pos", F.count("*").over(w))
    g = ranked.groupBy("gene_id", "group", "pos").agg(F.sum("r").alias("rs"), F.count("*").alias("k"))
    genes = g.select("gene_id", "pos").distinct()
    d = genes.join(F.broadcast(sizes)).join(g.select("gene_id", "group", "rs", "k"), ["gene_id", "group"], "left").na.fill(0.0, ["rs"]).na.fill(0, ["k"])
    zeros = (F.col("n_all") - F.col("pos")).cast("double")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    r1 = (F.col("n1") - F.col("k")) * (zeros + 1) / 2 + F.col("rs") + F.col("k") * zeros
    z = (r1 - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    out = d.where("n2 > 0").select("gene_id", "group", z.alias("z")).withColumn("p", stats.normal_two_sided(F.col("z")))
    return stats.adjust(out, "p", "q", "bh", ("group",), ("gene_id",))


def top_markers(scores: DataFrame, n: int, score: str = "z", total: int | None = None) -> DataFrame:
    """(group, rank, gene_id, score): each group's ``n`` best genes; then each gene stays only where it came first, groups in order.

    With ``total`` only the first so many of these rows are kept, groups in order.
    """
    w = Window.partitionBy("group").orderBy(F.col(score).desc(), "gene_id")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    first = Window.partitionBy("gene_id").orderBy("group")
    once = top.withColumn("seen", F.row_number().over(first)).where("seen = 1").select("group", "rank", "gene_id", F.col(score).alias("score"))
    return once.orderBy("group", "rank").limit(total) if total else once


def marker_summary(tested: DataFrame, folds: DataFrame, groups: DataFrame, top: DataFrame, extreme: float = 10.0) -> DataFrame:
    """(group, n_cells, n_markers, mean_log2fc, median_q, suspicious) of the markers ``top``; suspicious where a mean fold change passes ``extreme``."""
    x = top.select("group", "gene_id").join(tested.select("group", "gene_id", "q"), ["group", "gene_id"]).join(folds.select("group", "gene_id", "log2fc"), ["group", "gene_id"])
    got = x.groupBy("group").agg(F.count("*").alias("n_markers"), F.avg("log2fc").alias("mean_log2fc"), F.median("q").alias("median_q"))
    cells = groups.groupBy("group").agg(F.count("*").alias("n_cells"))
    return cells.join(got, "group").withColumn("suspicious", F.abs("mean_log2fc") > extreme)


def group_counts(groups: DataFrame) -> DataFrame:
    """(group, n): observations of each group."""
    return groups.groupBy("group").agg(F.count("*").alias("n"))


def sample_conditions(samples: DataFrame, least: int = 2) -> DataFrame:
    """(condition, n_samples): a sample counts for the condition of its smallest obs_id; an error if a condition has fewer than ``least``."""
    of = samples.groupBy("sample").agg(F.min_by("condition", "obs_id").alias("condition"))
    counts = of.groupBy("condition").agg(F.count("*").alias("n_samples"))
    if few := [r[0] for r in counts.where(F.col("n_samples") < least).orderBy("condition").collect()]:
        raise DataError(f"fewer than {least} samples of condition {', '.join(map(str, few))}")
    return counts


def log2_fold_change(raw: DataFrame, groups: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """(gene_id, group, log2fc) from raw counts scaled to the median library of all cells."""
    from cellweave.operators.preprocess import normalise

    m = group_moments(normalise(raw, log=False), groups)
    return m.select("gene_id", "group", F.log2((F.col("m1") + pseudocount) / (F.col("m2") + pseudocount)).alias("log2fc"))


def pseudobulk(counts: DataFrame, samples: DataFrame, by: tuple[str, ...] = ("sample", "condition"), min_cells: int = 10) -> DataFrame:
    """(*by, gene_id, value, n_cells): counts summed over the cells of a sample (and stratum); samples of too few cells go."""
    n = samples.groupBy(*by).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    x = counts.join(samples.select("obs_id", *by), "obs_id").groupBy(*by, "gene_id").agg(F.sum("value").alias("value"))
    return x.join(F.broadcast(n), list(by))


def size_factors(bulk: DataFrame, sample: str = "sample", positive: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, sample, size_factor): median over genes of count over the gene's geometric mean, genes positive in every sample.

    With ``positive``, where no such gene exists: geometric means over all samples of the positive counts (zeros count as
    one), medians over the genes that a sample has, and factors of geometric mean one. Each set of ``by`` stands alone.
    """
    beside = lambda rows, sets: rows.join(F.broadcast(sets), list(by) if by else F.lit(True))  # noqa: E731  a row per set
    n = bulk.select(*by, sample).distinct().groupBy(*by).agg(F.count("*").alias("n_s"))
    logs = beside(bulk.where("value > 0").groupBy(*by, "gene_id").agg(F.sum(F.log("value")).alias("sl"), F.count("*").alias("n_g")), n)
    means = logs.select(*by, "gene_id", (F.col("sl") / F.col("n_s")).alias("lg")) if positive else logs.where("n_g = n_s").select(*by, "gene_id", (F.col("sl") / F.col("n_g")).alias("lg"))
    out = bulk.where("value > 0").join(means, [*by, "gene_id"]).groupBy(*by, sample).agg(F.median(F.log("value") - F.col("lg")).alias("lf"))
    if positive:
        out = beside(out, out.groupBy(*by).agg(F.avg("lf").alias("mid"))).withColumn("lf", F.col("lf") - F.col("mid"))
    return out.select(*by, sample, F.exp("lf").alias("size_factor"))


def condition_fold_change(bulk: DataFrame, factors: DataFrame, a: str, b: str, pseudocount: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, gene_id, mean_a, mean_b, log2fc): means of size-normalised pseudobulks over the samples of each condition, zeros included."""
    x = bulk.join(F.broadcast(factors), "sample").withColumn("v", F.col("value") / F.col("size_factor"))
    n = bulk.select(*by, "sample", "condition").distinct().groupBy(*by).agg(F.count_if(F.col("condition") == a).alias("na"), F.count_if(F.col("condition") == b).alias("nb"))
    g = x.groupBy(*by, "gene_id").agg(F.sum(F.when(F.col("condition") == a, F.col("v")).otherwise(0.0)).alias("sa"), F.sum(F.when(F.col("condition") == b, F.col("v")).otherwise(0.0)).alias("sb"))
    g = g.join(F.broadcast(n), list(by)) if by else g.join(F.broadcast(n))
    g = g.where("na > 0 and nb > 0").withColumns({"mean_a": F.col("sa") / F.col("na"), "mean_b": F.col("sb") / F.col("nb")})
    return g.select(*by, "gene_id", "mean_a", "mean_b", F.log2((F.col("mean_a") + pseudocount) / (F.col("mean_b") + pseudocount)).alias("log2fc"))


def negative_binomial_wald(bulk: DataFrame, factors: DataFrame, a: str, b: str, shrink: bool = True) -> DataFrame:
    """(gene_id, base_mean, dispersion, log2fc, se, p, q): two-condition negative-binomial regression, see ``dispersion.wald``."""
    return dispersion.wald(bulk, factors, a, b, shrink=shrink)


def regulated(tested: DataFrame, q: float = 0.05, fold: float = 0.0, n: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, direction, rank, gene_id, log2fc, q): significant genes, up or down, by falling size of the fold change; the first ``n`` of each."""
    t = tested.where((F.col("q") < q) & (F.abs("log2fc") > fold)).withColumn("direction", F.when(F.col("log2fc") > 0, "up").otherwise("down"))
    w = Window.partitionBy(*by, "direction").orderBy(F.abs("log2fc").desc(), "gene_id")
    t = t.withColumn("rank", F.row_number().over(w))
    return (t.where(F.col("rank") <= n) if n else t).select(*by, "direction", "rank", "gene_id", "log2fc", "q")


def wald_by_stratum(counts: DataFrame, samples: DataFrame, a, b, stratum: str = "cell_type", min_cells: int = 10) -> DataFrame:
    """``negative_binomial_wald`` within each value of ``stratum``, with size factors and a trend of its own: (stratum, gene_id, ...),
    BH within it. The strata are a key of one job; those with one condition, and cells of none, are left out."""
    bulk = cut(pseudobulk(counts, samples, ("sample", "condition", stratum), min_cells))
    sides = bulk.where(F.col("condition").isin(a, b)).groupBy(stratum).agg(F.countDistinct("condition").alias("n"))
    if sides.where("n = 2").isEmpty():
        raise DataError(f"no {stratum} has samples of both conditions")
    return dispersion.wald(bulk, size_factors(bulk, positive=True, by=(stratum,)), a, b, (stratum,))


def logistic_markers(dense: DataFrame, groups: DataFrame, regularisation: float = 0.1) -> DataFrame:
    """(group, gene_id, coefficient) of a multinomial logistic regression on the chosen genes (MLlib)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    from cellweave.operators.embedding import to_vectors

    genes = [r[0] for r in dense.select("gene_id").distinct().orderBy("gene_id").collect()]
    x = to_vectors(dense).join(groups.select("obs_id", F.col("group").cast("string").alias("group")), "obs_id").withColumn("features", array_to_vector("v"))
    index = StringIndexer(inputCol="group", outputCol="y", stringOrderType="alphabetAsc").fit(x)
    fit = LogisticRegression(labelCol="y", family="multinomial", regParam=regularisation, maxIter=100).fit(index.transform(x))
    rows = [(label, g, float(c)) for label, row in zip(index.labels, fit.coefficientMatrix.toArray(), strict=True) for g, c in zip(genes, row, strict=True)]
    return dense.sparkSession.createDataFrame(rows, f"group string, gene_id {dict(dense.dtypes)['gene_id']}, coefficient double")
