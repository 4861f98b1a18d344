"""Spatial statistics on an edge table (src, dst[, w]) and dense values (obs_id, gene_id, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.errors import ParameterError
from cellweave.functions import stats
from cellweave.operators.pairs import pair_counts
from cellweave.operators.permutations import coded, drawn_codes, enrichment_counts, lag_counts, local_counts, order_rows
from cellweave.operators.preprocess import densify
from cellweave.storage import cut

#: Genes whose values an observation carries in one row.
GENES_A_ROW = 256


def _weights(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.col("w").cast("double").alias("w") if "w" in edges.columns else F.lit(1.0).alias("w"))


def centred(values: DataFrame) -> DataFrame:
    """Adds z, the deviation from the gene's mean over all its rows (dense values: zeros are rows)."""
    mean = values.groupBy("gene_id").agg(F.avg("value").alias("mean"))
    return values.join(mean, "gene_id").select("obs_id", "gene_id", "value", (F.col("value") - F.col("mean")).alias("z"))


def gene_rows(values: DataFrame, column: str = "value") -> DataFrame:
    """(obs_id, block, genes, v): dense values with the genes of an observation as arrays, in blocks of about ``GENES_A_ROW``.

    So a graph's edges carry a few rows and not one for each gene. Each (obs, gene) stands once; where one is missing it is 0.
    """
    n, n_genes = values.agg(F.count("*"), F.countDistinct("gene_id")).first()
    obs = values.select("obs_id").distinct()
    if n != obs.count() * n_genes:
        values = densify(values.select("obs_id", "gene_id", F.col(column).alias("value")), obs, values).withColumnRenamed("value", column)
    block = F.pmod(F.xxhash64("gene_id"), F.lit(max(1, -(-n_genes // GENES_A_ROW)))).cast("int")
    rows = values.groupBy("obs_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("gene_id", column))).alias("s"))
    return rows.select("obs_id", "block", F.col("s.gene_id").alias("genes"), F.col(f"s.{column}").alias("v"))


def graph_moments(edges: DataFrame) -> DataFrame:
    """One row (s0, s1, s2): weight sums that the variances of Moran's I and Geary's C need."""
    e = _weights(edges)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("r"))
    both = e.join(back, ["src", "dst"], "full").select((F.coalesce("w", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))).alias("t"))
    s1 = both.agg((F.sum(F.col("t") * F.col("t")) / 2).alias("s1"))
    ends = e.select(F.col("src").alias("i"), "w").unionByName(e.select(F.col("dst").alias("i"), "w")).groupBy("i").agg(F.sum("w").alias("d"))
    s2 = ends.agg(F.sum(F.col("d") * F.col("d")).alias("s2"))
    return e.agg(F.sum("w").alias("s0")).join(s1).join(s2)  # three single rows


def _edge_sums(edges: DataFrame, rows: DataFrame, term) -> DataFrame:
    """(gene_id, num): the sum over edges of ``term`` (weight, value at src, value at dst) per gene; partial sums before any shuffle of genes."""
    a = rows.select(F.col("obs_id").alias("src"), "block", "genes", F.col("v").alias("a"))
    b = rows.select(F.col("obs_id").alias("dst"), "block", F.col("v").alias("b"))
    x = _weights(edges).join(a, "src").join(b, ["dst", "block"]).select("w", F.inline(F.arrays_zip("genes", "a", "b")).alias("gene_id", "a", "b"))
    return x.groupBy("gene_id").agg(F.sum(term(F.col("w"), F.col("a"), F.col("b"))).alias("num"))


def _lag_rows(edges: DataFrame, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, obs_id, block, lag): the weighted sum of the arrays of the neighbours; ``edges`` has src, dst, w as they are."""
    near = edges.join(rows.select(*by, F.col("obs_id").alias("dst"), "block", "v"), "dst")
    near = near.groupBy(*by, F.col("src").alias("obs_id"), "block").agg(F.collect_list(F.struct("w", "v")).alias("near"))  # an observation's neighbours
    zero = F.array_repeat(F.lit(0.0), F.size(F.col("near")[0]["v"]))
    lag = F.aggregate("near", zero, lambda acc, x: F.zip_with(acc, x["v"], lambda p, q: p + x["w"] * q))
    return near.select(*by, "obs_id", "block", lag.alias("lag"))


def _standard(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with the weights of each src summing to one."""
    e = _weights(edges)
    return e.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(gene_id, moran_i, expected, variance, z, p): global Moran's I with the normal approximation; genes without variance are left out."""
    edges, z = cut(_weights(edges)), centred(values)
    m = z.groupBy("gene_id").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    c = _edge_sums(edges, gene_rows(z, "z"), lambda w, a, b: w * a * b)
    out = c.join(m, "gene_id").where("zz > 0").join(F.broadcast(graph_moments(edges)))
    n = F.col("n").cast("double")
    i = n / F.col("s0") * F.col("num") / F.col("zz")
    e = -1.0 / (n - 1)
    var = (n * n * F.col("s1") - n * F.col("s2") + 3 * F.col("s0") * F.col("s0")) / ((n * n - 1) * F.col("s0") * F.col("s0")) - e * e
    out = out.select("gene_id", i.alias("moran_i"), e.alias("expected"), var.alias("variance"))
    out = out.withColumn("z", (F.col("moran_i") - F.col("expected")) / F.sqrt("variance"))
    return out.withColumn("p", stats.normal_two_sided(F.col("z")))


def gearys_c(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(gene_id, geary_c, variance, z, p)."""
    edges, z = cut(_weights(edges)), centred(values)
    m = z.groupBy("gene_id").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    c = _edge_sums(edges, gene_rows(z, "z"), lambda w, a, b: w * (a - b) * (a - b))
    n, s0 = F.col("n").cast("double"), F.col("s0")
    out = c.join(m, "gene_id").where("zz > 0").join(F.broadcast(graph_moments(edges)))
    var = ((2 * F.col("s1") + F.col("s2")) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)
    out = out.select("gene_id", ((n - 1) / (2 * s0) * F.col("num") / F.col("zz")).alias("geary_c"), var.alias("variance"))
    out = out.withColumn("z", (F.col("geary_c") - 1.0) / F.sqrt("variance"))
    return out.withColumn("p", stats.normal_two_sided(F.col("z")))


def _lag(edges: DataFrame, z: DataFrame, column: str = "z") -> DataFrame:
    """(obs_id, gene_id, lag) over row-standardised weights."""
    rows = gene_rows(z, column)
    genes = rows.groupBy("block").agg(F.first("genes").alias("genes"))
    lag = _lag_rows(_standard(edges), rows).join(F.broadcast(genes), "block")  # a row per block of genes
    return lag.select("obs_id", F.inline(F.arrays_zip("genes", "lag")).alias("gene_id", "lag"))


def _lisa_rows(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arrays (obs_id, block, genes, v, lag) of deviations, (gene_id, m2))."""
    z = centred(values)
    m2 = z.groupBy("gene_id").agg((F.sum(F.col("z") * F.col("z")) / (F.count("*") - 1)).alias("m2"))
    rows = gene_rows(z, "z")
    return rows.join(_lag_rows(_standard(edges), rows), ["obs_id", "block"]), m2


QUADRANT = "CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END"


def local_morans(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(obs_id, gene_id, z, lag, local_i, quadrant): LISA over row-standardised weights; quadrants HH 1, LH 2, LL 3, HL 4."""
    rows, m2 = _lisa_rows(edges, values)
    out = rows.select("obs_id", F.inline(F.arrays_zip("genes", "v", "lag")).alias("gene_id", "z", "lag")).join(m2, "gene_id").where("m2 > 0")
    return out.select("obs_id", "gene_id", "z", "lag", (F.col("z") * F.col("lag") / F.col("m2")).alias("local_i"), F.expr(QUADRANT).alias("quadrant"))


def permutation_order(values: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """(perm, obs_id, partner): for each permutation every obs gets another's place, by the order of a hash of (seed, perm, obs)."""
    return order_rows(values, permutations, seed)


def local_morans_p(edges: DataFrame, values: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """(obs_id, gene_id, local_i, quadrant, p_sim): conditional permutation: neighbours take the values of permuted places, the obs keeps its own.

    Chunks of permutations are counted side by side (``lag_counts``); no row is made for an observation and a permutation.
    """
    e = cut(_standard(edges))
    rows, m2 = _lisa_rows(e, values)
    rows = cut(rows)
    above = lag_counts(e, rows, permutations, seed)
    both = rows.join(above, ["obs_id", "block"]).select("obs_id", F.inline(F.arrays_zip("genes", "v", "lag", "above")).alias("gene_id", "z", "lag", "above"))
    count = both.join(m2, "gene_id").where("m2 > 0")
    p = (F.least(F.col("above"), permutations - F.col("above")) + 1.0) / (permutations + 1.0)
    return count.select("obs_id", "gene_id", (F.col("z") * F.col("lag") / F.col("m2")).alias("local_i"), F.expr(QUADRANT).alias("quadrant"), p.alias("p_sim"))


def lisa_clusters(tested: DataFrame, alpha: float = 0.05, fdr: bool = True) -> DataFrame:
    """``local_morans_p`` with q (BH within the gene; p_sim without ``fdr``) and cluster: HH, LL, HL, LH where it is below ``alpha``, else ns."""
    t = stats.adjust(tested, "p_sim", "q", "bh", ("gene_id",), ("obs_id",)) if fdr else tested.withColumn("q", F.col("p_sim"))
    name = F.element_at(F.array(*map(F.lit, ("HH", "LH", "LL", "HL"))), F.col("quadrant"))
    return t.withColumn("cluster", F.when(F.col("q") < alpha, name).otherwise("ns"))


def lisa_summary(clusters: DataFrame) -> DataFrame:
    """(gene_id, mean_i, sd_i, min_i, max_i, n_significant, n_hotspots, n_coldspots, n_high_outliers, n_low_outliers); population deviation."""
    n = lambda c: F.count_if(F.col("cluster") == c)
    i = F.col("local_i")
    return clusters.groupBy("gene_id").agg(F.avg(i).alias("mean_i"), F.stddev_pop(i).alias("sd_i"), F.min(i).alias("min_i"), F.max(i).alias("max_i"), F.count_if(F.col("cluster") != "ns").alias("n_significant"), n("HH").alias("n_hotspots"), n("LL").alias("n_coldspots"), n("HL").alias("n_high_outliers"), n("LH").alias("n_low_outliers"))


def getis_ord(edges: DataFrame, values: DataFrame, alpha: float = 0.05, correction: str = "none") -> DataFrame:
    """(obs_id, gene_id, g_z, p, q, spot): Gi* with the obs itself among its neighbours; hot, cold or ns at the two-sided level.

    ``correction``: none (q is p), bonferroni (over genes, as the level is divided by them) or bh (within each gene).
    """
    star = _weights(edges).select("src", "dst").unionByName(values.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst")).distinct()).distinct()
    star = star.withColumn("k", F.count("*").over(Window.partitionBy("src"))).withColumn("w", 1.0 / F.col("k"))
    star = cut(star)
    size = star.groupBy(F.col("src").alias("obs_id")).agg(F.first("k").alias("k"))
    s = values.groupBy("gene_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    rows = gene_rows(values)
    genes = rows.groupBy("block").agg(F.first("genes").alias("genes"))
    sums = _lag_rows(star.select("src", "dst", "w"), rows).join(F.broadcast(genes), "block").select("obs_id", F.inline(F.arrays_zip("genes", "lag")).alias("gene_id", "wx"))
    n = F.col("n").cast("double")
    g = (F.col("wx") - F.col("mean")) / (F.col("s") * F.sqrt((n / F.col("k") - 1) / (n - 1)))
    out = sums.join(size, "obs_id").join(s, "gene_id").where("s > 0 and n > k").select("obs_id", "gene_id", g.alias("g_z"))
    out = out.withColumn("p", stats.normal_two_sided(F.col("g_z")))
    bar = stats.normal_quantile(1 - alpha / 2)
    if correction == "none":
        out = out.withColumn("q", F.col("p"))
    elif correction == "bonferroni":
        m = values.select("gene_id").distinct().count()
        out, bar = out.withColumn("q", F.least(F.lit(1.0), F.col("p") * m)), stats.normal_quantile(1 - alpha / m / 2)
    elif correction == "bh":
        out = stats.adjust(out, "p", "q", "bh", ("gene_id",), ("obs_id",))
    else:
        raise ParameterError(f"unknown correction {correction}")
    sure = F.col("q") < alpha if correction == "bh" else F.lit(True)
    return out.withColumn("spot", F.when((F.col("g_z") > bar) & sure, "hot").when((F.col("g_z") < -bar) & sure, "cold").otherwise("ns"))


def getis_summary(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(gene_id, mean_z, sd_z, n_hot, n_cold, n_significant) of ``getis_ord``; population deviation, significance by q."""
    z = F.col("g_z")
    return tested.groupBy("gene_id").agg(F.avg(z).alias("mean_z"), F.stddev_pop(z).alias("sd_z"), F.count_if(F.col("spot") == "hot").alias("n_hot"), F.count_if(F.col("spot") == "cold").alias("n_cold"), F.count_if(F.col("q") < alpha).alias("n_significant"))


def bivariate_moran(edges: DataFrame, values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gene_x, gene_y, moran_xy) for rows of ``pairs``: x' W y over row-standardised weights; 0 without variance."""
    z = centred(values)
    zz = z.groupBy("gene_id").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n"))
    lag = _lag(edges, z).withColumnRenamed("gene_id", "gene_y")
    x = z.select("obs_id", F.col("gene_id").alias("gene_x"), "z").join(pairs, "gene_x")
    num = x.join(lag, ["obs_id", "gene_y"]).groupBy("gene_x", "gene_y").agg(F.sum(F.col("z") * F.col("lag")).alias("num"), F.count("*").alias("s0"))
    out = num.join(zz.select(F.col("gene_id").alias("gene_x"), F.col("zz").alias("xx"), "n"), "gene_x").join(zz.select(F.col("gene_id").alias("gene_y"), F.col("zz").alias("yy")), "gene_y")
    down = F.sqrt(F.col("xx") * F.col("yy"))
    return out.select("gene_x", "gene_y", F.when(down > 0, F.col("n") / F.col("s0") * F.col("num") / down).otherwise(0.0).alias("moran_xy"))


def join_count(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (bb, ww, bw, j) for binary ``labels`` (obs_id, label in 0, 1); directed weights count half."""
    y = labels.select("obs_id", F.col("label").cast("double").alias("y"))
    e = _weights(edges).join(y.select(F.col("obs_id").alias("src"), F.col("y").alias("a")), "src").join(y.select(F.col("obs_id").alias("dst"), F.col("y").alias("b")), "dst")
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    return e.agg((F.sum(w * a * b) / 2).alias("bb"), (F.sum(w * (1 - a) * (1 - b)) / 2).alias("ww"), (F.sum(w * (a - b) * (a - b)) / 2).alias("bw"), (F.sum(w) / 2).alias("j"))


def binary_labels(labels: DataFrame) -> DataFrame:
    """(obs_id, label in 0, 1) of labels of exactly two categories, the larger of which is 1; ParameterError for any other number."""
    kinds = [r[0] for r in labels.select("label").distinct().orderBy("label").limit(3).collect()]
    if len(kinds) != 2:
        raise ParameterError(f"join counts need two categories, not {'more' if len(kinds) > 2 else len(kinds)}; use local_join_count")
    return labels.select("obs_id", (F.col("label") == kinds[1]).cast("int").alias("label"))


def join_count_p(edges: DataFrame, labels: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """``join_count`` of any two categories with p_bb, the share of permuted labels with as many joins of the larger category."""
    y, e = cut(binary_labels(labels)), cut(_weights(edges))
    perm = permutation_order(y, permutations, seed).hint("merge").join(y.withColumnRenamed("obs_id", "partner"), "partner").where("label = 1").select("perm", "obs_id")
    drawn = e.join(perm.withColumnRenamed("obs_id", "src").hint("merge"), "src").join(perm.withColumnRenamed("obs_id", "dst").hint("merge"), ["perm", "dst"]).groupBy("perm").agg((F.sum("w") / 2).alias("c"))
    one = join_count(e, y)
    # A permutation without any such join has no row, and zero joins.
    more = F.col("more") + F.when(F.col("bb") <= 0, permutations - F.col("seen")).otherwise(0)
    return one.join(drawn.join(F.broadcast(one.select(F.col("bb").alias("b0")))).agg(F.count_if(F.col("c") >= F.col("b0")).alias("more"), F.count("*").alias("seen"))).select("bb", "ww", "bw", "j", ((more + 1.0) / (permutations + 1.0)).alias("p_bb"))


def local_join_count(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(obs_id, label, ljc): neighbours of the same category as the obs, per obs."""
    y = labels.select("obs_id", "label")
    e = _weights(edges).join(y.select(F.col("obs_id").alias("dst"), F.col("label").alias("other")), "dst")
    got = y.join(e, y["obs_id"] == e["src"], "left").groupBy("obs_id", "label").agg(F.sum(F.when(F.col("label") == F.col("other"), F.col("w")).otherwise(0.0)).alias("ljc"))
    return got


def neighbourhood_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_a, label_b, n): edges from a to b."""
    y = labels.select("obs_id", "label")
    return (
        edges.join(y.select(F.col("obs_id").alias("src"), F.col("label").alias("label_a")), "src")
        .join(y.select(F.col("obs_id").alias("dst"), F.col("label").alias("label_b")), "dst")
        .groupBy("label_a", "label_b")
        .agg(F.count("*").alias("n"))
    )


def neighbourhood_enrichment(edges: DataFrame, labels: DataFrame, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """(label_a, label_b, n, zscore) against permuted labels; pairs never seen in a permutation count zero there."""
    codes, names = coded(labels)
    drawn = enrichment_counts(edges, drawn_codes(codes, permutations, seed), len(names))
    kind = dict(labels.dtypes)["label"]
    a, b = (F.broadcast(labels.sparkSession.createDataFrame(list(enumerate(names)), f"{c} int, label_{c} {kind}")) for c in "ab")
    drawn = drawn.join(a, "a").join(b, "b")
    sums = drawn.groupBy("label_a", "label_b").agg((F.sum("c") / permutations).alias("mean"), (F.sum(F.col("c") * F.col("c")) / permutations).alias("sq"))
    sums = sums.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean"))))
    out = neighbourhood_counts(edges, labels).join(sums, ["label_a", "label_b"], "full").na.fill(0, ["n"]).na.fill(0.0, ["mean", "sd"])
    return out.select("label_a", "label_b", "n", F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")).alias("zscore"))


def co_occurrence(points: DataFrame, labels: DataFrame, bins: int = 50) -> DataFrame:
    """(label_a, label_b, bin, ratio): P(b near a within the distance of the bin) / P(b near anything), cumulative.

    Distances go up to half of the largest extent; pairs are counted by blocks (``pair_counts``).
    """
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    y = labels.select("obs_id", "label")
    counts = pair_counts(points.select("obs_id", "x", "y").join(y, "obs_id"), math.hypot(x1 - x0, y1 - y0) / 2, bins, False, label="label")
    grid = y.select(F.col("label").alias("label_a")).distinct().join(y.select(F.col("label").alias("label_b")).distinct()).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    counts = grid.join(counts, ["label_a", "label_b", "bin"], "left").na.fill(0, ["n"])
    w = Window.partitionBy("label_a", "label_b").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("c", F.sum("n").over(w))
    a_all, b_all, every = (F.sum("c").over(Window.partitionBy(*k)) for k in (("label_a", "bin"), ("label_b", "bin"), ("bin",)))
    return c.withColumns({"a_all": a_all, "b_all": b_all, "every": every}).where("c > 0").select("label_a", "label_b", "bin", ((F.col("c") / F.col("a_all")) / (F.col("b_all") / F.col("every"))).alias("ratio"))


def _ripley(points: DataFrame, by: tuple[str, ...], steps: int, area: float, top: float) -> DataFrame:
    """(*by, step, l) for point sets (*by, obs_id, x, y); pairs are counted by blocks within each set."""
    hist = pair_counts(points, top, steps, True, by).withColumnRenamed("bin", "step")
    grid = points.groupBy(*by).agg(F.count("*").alias("size")).where("size > 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    c = grid.join(hist, [*by, "step"], "left").na.fill(0, ["n"]).withColumn("c", F.sum("n").over(w))
    return c.select(*by, "step", F.sqrt(F.lit(area) * F.col("c") / (F.lit(math.pi) * F.col("size") * (F.col("size") - 1))).alias("l"))


def ripley_l(points: DataFrame, labels: DataFrame, steps: int = 50) -> DataFrame:
    """(label, step, l): Ripley's L per label at ``steps`` radii up to a quarter of the extent; the area is that of the bounding box."""
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    labelled = points.select("obs_id", "x", "y").join(labels.select("obs_id", "label"), "obs_id")
    return _ripley(labelled, ("label",), steps, (x1 - x0) * (y1 - y0), max(x1 - x0, y1 - y0) / 4)


def ripley_envelopes(points: DataFrame, labels: DataFrame, steps: int = 50, simulations: int = 20, seed: int = 42, most: int = 1000) -> DataFrame:
    """(label, step, l, low, high, p): ``ripley_l`` with the least and greatest L of ``simulations`` uniform point sets of as many
    points (at most ``most``) in the bounding box, and the share of simulations that reach it.

    Coordinates are drawn by a hash of (seed, axis, simulation, label, number).
    """
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    draw = lambda axis: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(axis), "sim", "label", "obs_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    sizes = labels.groupBy("label").agg(F.least(F.lit(most), F.count("*")).cast("int").alias("size")).where("size > 1")
    drawn = sizes.select("label", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("sim"), "size").select("label", "sim", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("obs_id"))
    drawn = drawn.select("label", "sim", "obs_id", (F.lit(x0) + F.lit(x1 - x0) * draw("x")).alias("x"), (F.lit(y0) + F.lit(y1 - y0) * draw("y")).alias("y"))
    null = _ripley(drawn, ("label", "sim"), steps, (x1 - x0) * (y1 - y0), max(x1 - x0, y1 - y0) / 4)
    both = null.withColumnRenamed("l", "ls").join(ripley_l(points, labels, steps), ["label", "step"])
    return both.groupBy("label", "step", "l").agg(F.min("ls").alias("low"), F.max("ls").alias("high"), ((F.count_if(F.col("ls") >= F.col("l")) + 1.0) / (F.count("*") + 1.0)).alias("p"))


def refine_labels(edges: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(obs_id, label, refined): ``edges`` with rank, the obs itself among its neighbours; if the share of other labels reaches
    ``threshold`` the most frequent label is taken, ties to the label met first."""
    y = labels.select("obs_id", "label")
    near = edges.select(F.col("src").alias("obs_id"), "dst", "rank").join(y.select(F.col("obs_id").alias("dst"), F.col("label").alias("other")).hint("merge"), "dst")
    votes = near.groupBy("obs_id", "other").agg(F.count("*").alias("n"), F.min("rank").alias("met"))
    best = votes.groupBy("obs_id").agg(F.min_by("other", F.struct((-F.col("n")).alias("a"), "met")).alias("top"), F.sum("n").alias("total"))
    own = votes.join(y.hint("merge"), "obs_id").where("label = other").select("obs_id", F.col("n").alias("same"))
    out = y.join(best.hint("merge"), "obs_id", "left").join(own.hint("merge"), "obs_id", "left").na.fill(0, ["same"])
    other = (F.col("total") - F.col("same")) / F.col("total")
    return out.select("obs_id", "label", F.when(other >= threshold, F.col("top")).otherwise(F.col("label")).alias("refined"))


def network_properties(edges: DataFrame, nodes: DataFrame, paths: bool = True) -> DataFrame:
    """One row: nodes, edges, density, components, whether connected, size and share of the largest component, average clustering,
    degree mean and population deviation; with ``paths`` diameter and radius too (null unless connected), which take every pair of nodes."""
    from cellweave.operators import neighbors

    edges = cut(edges.select("src", "dst"))
    n = nodes.agg(F.count("*").alias("n_nodes"))
    c = nodes.select("obs_id").join(neighbors.clustering(edges), "obs_id", "left").na.fill(0, ["degree"]).na.fill(0.0, ["clustering"])
    deg = c.agg((F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("clustering").alias("avg_clustering"), F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_sd"))
    comp = cut(neighbors.connected(edges, nodes).groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest")))
    out = n.join(deg).join(comp)
    connected = F.col("components") == 1
    out = out.withColumns({"density": F.when(F.col("n_nodes") > 1, 2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0), "connected": connected, "largest_share": F.col("largest") / F.col("n_nodes")})
    if not paths:
        return out
    if comp.first()["components"] == 1:
        far = paths_from(edges, nodes).select(F.col("far")).agg(F.coalesce(F.max("far"), F.lit(0)).cast("int").alias("diameter"), F.coalesce(F.min("far"), F.lit(0)).cast("int").alias("radius"))
        return out.join(far)
    return out.withColumns({"diameter": F.lit(None).cast("int"), "radius": F.lit(None).cast("int")})


def local_join_count_p(edges: DataFrame, labels: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """(obs_id, label, ljc, p_sim): neighbours take permuted labels, the obs keeps its own."""
    one = cut(local_join_count(edges, labels))
    codes, _ = coded(labels)
    codes = cut(codes)
    above = local_counts(_weights(edges), one.join(codes, "obs_id").select("obs_id", "code", "ljc"), drawn_codes(codes, permutations, seed))
    p = (F.coalesce("above", F.lit(0)) + 1.0) / (permutations + 1.0)
    return one.join(above, "obs_id", "left").select("obs_id", "label", "ljc", p.alias("p_sim"))


def local_join_summary(tested: DataFrame, level: float = 0.05) -> DataFrame:
    """(label, total, mean, sd, n_significant) of ``local_join_count_p``; population deviation."""
    return tested.groupBy("label").agg(F.sum("ljc").alias("total"), F.avg("ljc").alias("mean"), F.stddev_pop("ljc").alias("sd"), F.count_if(F.col("p_sim") < level).alias("n_significant"))


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(obs_id, closeness): reachable others over the sum of their distances, scaled by the share of nodes reached."""
    n = nodes.agg(F.count("*").alias("n"))
    h = paths_from(edges, nodes).where("k > 0").select("obs_id", "k", "s")
    out = nodes.select("obs_id").join(h, "obs_id", "left").join(F.broadcast(n))
    return out.select("obs_id", F.when(F.col("k").isNotNull() & (F.col("n") > 1), F.col("k") / F.col("s") * F.col("k") / (F.col("n") - 1)).otherwise(0.0).alias("closeness"))


def paths_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(obs_id, k, s, far): for each node how many others it reaches in the undirected graph, their distances' sum and the largest."""
    from cellweave.operators.paths import from_sources, reach

    return from_sources(edges, nodes, reach, "k long, s long, far int")


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(obs_id, betweenness): Brandes' algorithm from every node, many sources side by side (see ``paths``); normalised."""
    from cellweave.operators.paths import from_sources, passing

    got = from_sources(edges, nodes, passing, "b double").groupBy("obs_id").agg(F.sum("b").alias("b"))
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    return nodes.select("obs_id").join(got, "obs_id", "left").join(F.broadcast(n)).select("obs_id", F.when(F.col("n") > 2, F.coalesce("b", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness"))


def centrality_by_label(per_node: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    return per_node.join(labels.select("obs_id", "label"), "obs_id").groupBy("label").agg(F.avg(column).alias(column))
