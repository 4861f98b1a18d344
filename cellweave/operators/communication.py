"""Ligand-receptor scoring between groups of cells. Pairs are rows (ligand, receptor) of gene ids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.errors import ParameterError
from cellweave.functions import stats


def group_means(expr: DataFrame, groups: DataFrame, min_cells: int = 1) -> DataFrame:
    """(group, gene_id, mean, fraction): zeros included; groups of too few cells left out."""
    n = groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    x = expr.join(groups.select("obs_id", "group"), "obs_id").groupBy("group", "gene_id").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    return x.join(F.broadcast(n), "group").select("group", "gene_id", (F.col("s") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("fraction"))


def pair_scores(expr: DataFrame, groups: DataFrame, pairs: DataFrame, min_fraction: float = 0.1, min_cells: int = 1) -> DataFrame:
    """(source, target, ligand, receptor, score): mean of the ligand's mean in the source and the receptor's in the target, where both are expressed by enough cells."""
    m = group_means(expr, groups, min_cells).where(F.col("fraction") >= min_fraction)
    lig = m.select(F.col("group").alias("source"), F.col("gene_id").alias("ligand"), F.col("mean").alias("lm"))
    rec = m.select(F.col("group").alias("target"), F.col("gene_id").alias("receptor"), F.col("mean").alias("rm"))
    return pairs.join(lig, "ligand").join(rec, "receptor").select("source", "target", "ligand", "receptor", ((F.col("lm") + F.col("rm")) / 2).alias("score"))


def pair_p_values(expr: DataFrame, groups: DataFrame, pairs: DataFrame, permutations: int = 1000, seed: int = 42, min_fraction: float = 0.1) -> DataFrame:
    """Adds p (share of label permutations with a mean at least as large) and q (BH within each pair over the group pairs)."""
    from cellweave.operators import permutations as drawn
    from cellweave.storage import cut

    obs = pair_scores(expr, groups, pairs, min_fraction)
    genes = pairs.select(F.col("ligand").alias("gene_id")).unionByName(pairs.select(F.col("receptor").alias("gene_id"))).distinct()
    x = expr.join(genes, "gene_id", "left_semi")
    codes, names = drawn.coded(groups.withColumnRenamed("group", "label"))
    codes = cut(codes)
    sums = drawn.group_sums(x, drawn.drawn_codes(codes, permutations, seed), len(names), permutations)
    n = codes.groupBy("code").agg(F.count("*").alias("n"))
    named = expr.sparkSession.createDataFrame(list(enumerate(names)), f"code int, group {dict(groups.dtypes)['group']}")
    m = sums.join(F.broadcast(n), "code").join(F.broadcast(named), "code").select("group", "gene_id", F.transform("sums", lambda s: s / F.col("n")).alias("means"))
    lig = m.select(F.col("group").alias("source"), F.col("gene_id").alias("ligand"), F.col("means").alias("lm"))
    rec = m.select(F.col("group").alias("target"), F.col("gene_id").alias("receptor"), F.col("means").alias("rm"))
    d = obs.join(lig, ["source", "ligand"]).join(rec, ["target", "receptor"])
    above = F.aggregate(F.zip_with("lm", "rm", lambda a, b: (a + b) / 2 >= F.col("score") - 1e-12), F.lit(0), lambda acc, x: acc + x.cast("int"))
    out = d.select("source", "target", "ligand", "receptor", "score", (above / permutations).alias("p"))
    return stats.adjust(out, "p", "q", "bh", ("ligand", "receptor"), ("source", "target"))


def complexes(means: DataFrame, members: DataFrame, how: str = "min") -> DataFrame:
    """(group, complex, mean): a complex is as high as its lowest member, or its average; all members must be present."""
    n = members.groupBy("complex").agg(F.count("*").alias("size"))
    x = means.join(members, "gene_id").groupBy("group", "complex").agg((F.min if how == "min" else F.avg)("mean").alias("mean"), F.count("*").alias("k"))
    return x.join(F.broadcast(n), "complex").where("k = size").select("group", "complex", "mean")


def local_products(expr: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(obs_id, ligand, receptor, local): ligand of the obs times the mean receptor of its neighbours."""
    w = edges.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("src")))
    rec = expr.select(F.col("obs_id").alias("dst"), F.col("gene_id").alias("receptor"), F.col("value").alias("rv"))
    lag = w.join(rec, "dst").groupBy(F.col("src").alias("obs_id"), "receptor").agg(F.sum(F.col("w") * F.col("rv")).alias("lag"))
    lig = expr.select("obs_id", F.col("gene_id").alias("ligand"), "value").join(pairs, "ligand")
    return lig.join(lag, ["obs_id", "receptor"]).select("obs_id", "ligand", "receptor", (F.col("value") * F.col("lag")).alias("local"))


def microenvironments(points: DataFrame, groups: DataFrame, radius: float | None = None) -> DataFrame:
    """(environment, signature, group): distinct sets of groups within a radius of some obs, sets of two or more, numbered in order of signature.

    The radius is by default twice the median distance to the fifth neighbour.
    """
    from cellweave.operators import neighbors

    if radius is None:
        radius = 2 * neighbors.knn(points, 5).where("rank = 5").agg(F.median("d")).first()[0]
    g = groups.select("obs_id", F.col("group").cast("string").alias("group"))
    near = neighbors.radius_edges(points, radius).select("src", "dst").unionByName(points.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst")))
    sets = near.join(g.withColumnRenamed("obs_id", "dst"), "dst").groupBy("src").agg(F.sort_array(F.collect_set("group")).alias("groups")).where(F.size("groups") >= 2).select("groups").distinct()
    sets = sets.withColumn("signature", F.concat_ws("|", "groups")).withColumn("environment", F.row_number().over(Window.orderBy("signature")))
    return sets.select("environment", "signature", F.explode("groups").alias("group"))


def magnitudes(expr: DataFrame, groups: DataFrame, pairs: DataFrame, min_fraction: float = 0.1, min_cells: int = 3) -> DataFrame:
    """(source, target, ligand, receptor, mean, product, root): three magnitudes of a pair: the mean of both sides' means, their
    product, and the root of the product over itself plus the mean of all values of the genes in pairs."""
    genes = pairs.select(F.col("ligand").alias("gene_id")).unionByName(pairs.select(F.col("receptor").alias("gene_id"))).distinct()
    used = expr.join(genes, "gene_id", "left_semi")
    m = group_means(used, groups, min_cells).where(F.col("fraction") >= min_fraction)
    n = groups.agg(F.count("*").alias("n")).join(genes.agg(F.count("*").alias("g")))
    level = used.join(groups.select("obs_id"), "obs_id", "left_semi").agg(F.sum("value").alias("s")).join(n).select((F.col("s") / F.col("n") / F.col("g")).alias("level"))  # single rows
    lig = m.select(F.col("group").alias("source"), F.col("gene_id").alias("ligand"), F.col("mean").alias("lm"))
    rec = m.select(F.col("group").alias("target"), F.col("gene_id").alias("receptor"), F.col("mean").alias("rm"))
    x = pairs.join(lig, "ligand").join(rec, "receptor").join(F.broadcast(level))
    product = F.greatest(F.lit(0.0), F.col("lm") * F.col("rm"))
    root = F.sqrt(product)
    below = root + F.abs("level")
    return x.select("source", "target", "ligand", "receptor", ((F.col("lm") + F.col("rm")) / 2).alias("mean"), product.alias("product"), F.when(below > 0, root / below).otherwise(0.0).alias("root"))


def rank_aggregate(scores: DataFrame, columns: tuple[str, ...] = ("mean", "product", "root"), keys: tuple[str, ...] = ("source", "target", "ligand", "receptor")) -> DataFrame:
    """(*keys, rank): robust rank aggregation of several scores, the larger the better.

    Each score's mean rank over the number of rows; the k-th smallest of a row's m shares r is tested against k uniform draws
    of m (a binomial tail); the least of the m p-values, times m, at most one.
    """
    m = len(columns)
    ranked, n = scores, scores.count()
    for c in columns:
        ranked = stats.overall_rank(ranked, c, f"_{c}").withColumn(f"_{c}", F.col(f"_{c}") / n)
    shares = ranked.withColumn("_r", F.array_sort(F.array(*[F.col(f"_{c}") for c in columns])))

    def tail(k: int):
        r = F.col("_r")[k - 1]
        return sum((math.comb(m, j) * F.pow(r, F.lit(float(j))) * F.pow(1.0 - r, F.lit(float(m - j))) for j in range(k, m + 1)), F.lit(0.0))

    least = F.least(*[tail(k) for k in range(1, m + 1)]) if m > 1 else tail(1)
    return shares.select(*keys, F.least(F.lit(1.0), least * m).alias("rank"))


def local_similarity(expr: DataFrame, edges: DataFrame, pairs: DataFrame, metric: str = "cosine") -> DataFrame:
    """(obs_id, ligand, receptor, local) over an obs and its neighbours, all with the same weight: cosine, pearson, spearman (pearson of
    ranks over all obs) or jaccard (of the neighbours that have one or the other). Null where one side has no spread, or nothing."""
    if metric not in ("cosine", "pearson", "spearman", "jaccard"):
        raise ParameterError(f"unknown metric {metric}")
    genes = pairs.select(F.col("ligand").alias("gene_id")).unionByName(pairs.select(F.col("receptor").alias("gene_id"))).distinct()
    x = expr.join(genes, "gene_id", "left_semi").select("obs_id", "gene_id", "value")
    if metric == "spearman":
        x = x.select("obs_id", "gene_id", stats.average_rank("value", ("gene_id",)).alias("value"))
    both = pairs.join(x.select("obs_id", F.col("gene_id").alias("ligand"), F.col("value").alias("a")), "ligand")
    both = both.join(x.select("obs_id", F.col("gene_id").alias("receptor"), F.col("value").alias("b")), ["obs_id", "receptor"])
    star = edges.select("src", "dst").unionByName(expr.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst")).distinct()).distinct()
    near = star.join(both.withColumnRenamed("obs_id", "dst"), "dst").groupBy(F.col("src").alias("obs_id"), "ligand", "receptor")
    a, b = F.col("a"), F.col("b")
    if metric == "jaccard":
        local = F.try_divide(F.count_if((a > 0) & (b > 0)).cast("double"), F.count_if((a > 0) | (b > 0)))
        return near.agg(local.alias("local"))
    s = near.agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))
    if metric == "cosine":
        aa, bb, ab = F.col("aa"), F.col("bb"), F.col("ab")
    else:
        n = F.col("n")
        aa, bb, ab = F.col("aa") - F.col("sa") * F.col("sa") / n, F.col("bb") - F.col("sb") * F.col("sb") / n, F.col("ab") - F.col("sa") * F.col("sb") / n
    return s.select("obs_id", "ligand", "receptor", F.when((aa > 1e-12) & (bb > 1e-12), ab / F.sqrt(aa * bb)).alias("local"))


def global_similarity(expr: DataFrame, edges: DataFrame, pairs: DataFrame, permutations: int = 100, seed: int = 42) -> DataFrame:
    """(ligand, receptor, moran, lee, p, q): bivariate Moran (values against the lag) and Lee (lag against lag) of each pair over
    row-standardised weights, the share of permutations of the receptor's places with as large a Moran, and BH of it."""
    from cellweave.operators import spatial
    from cellweave.operators.permutations import pair_products, pair_sums
    from cellweave.storage import cut

    genes = pairs.select(F.col("ligand").alias("gene_id")).unionByName(pairs.select(F.col("receptor").alias("gene_id"))).distinct()
    z = cut(spatial.centred(expr.join(genes, "gene_id", "left_semi")).select("obs_id", "gene_id", "z"))
    e = cut(edges.select("src", "dst"))
    zz = z.groupBy("gene_id").agg(F.sum(F.col("z") * F.col("z")).alias("zz"))
    # Values and lags stand in arrays, a row an obs: neither a pair nor a gene is a row.
    blocks = spatial.gene_rows(z, "z")
    both = blocks.join(spatial._lag_rows(spatial._standard(e), blocks).withColumn("near", F.lit(1)), ["obs_id", "block"], "left")
    both = both.select("obs_id", F.struct("block", "genes", "v", F.coalesce("lag", F.transform("v", lambda _: F.lit(0.0))).alias("lag"), F.coalesce("near", F.lit(0)).alias("near")).alias("s"))
    both = both.groupBy("obs_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    both = cut(both.select("obs_id", *[F.flatten(f"s.{c}").alias(c) for c in ("genes", "v", "lag")], F.array_max("s.near").alias("near")))
    kinds = ", ".join(f"{c} {t}" for c, t in pairs.select("ligand", "receptor").dtypes)
    listed = [tuple(r) for r in pairs.select("ligand", "receptor").distinct().collect()]
    numbered = expr.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(listed)], f"pair long, {kinds}")
    sums = pair_sums(both.where("near = 1"), listed).join(F.broadcast(numbered), "pair").drop("pair")
    down = F.sqrt(F.col("zl") * F.col("zr"))
    sums = sums.join(zz.select(F.col("gene_id").alias("ligand"), F.col("zz").alias("zl")), "ligand").join(zz.select(F.col("gene_id").alias("receptor"), F.col("zz").alias("zr")), "receptor").where(down > 0)
    one = sums.select("ligand", "receptor", "m", (F.col("m") / down).alias("moran"), (F.col("l") / down).alias("lee"))
    # The lag of permuted ligands is that of their places: sum over obs of z(partner) * lag.
    drawn = pair_products(both.drop("near"), listed, permutations, seed)
    null = drawn.join(F.broadcast(numbered), "pair")
    p = null.join(one.select("ligand", "receptor", "m"), ["ligand", "receptor"]).groupBy("ligand", "receptor").agg(((F.count_if(F.col("mp") >= F.col("m") - 1e-12) + 1.0) / (permutations + 1.0)).alias("p"))
    out = one.join(p, ["ligand", "receptor"]).select("ligand", "receptor", "moran", "lee", "p")
    return stats.adjust(out, "p", "q", "bh", (), ("ligand", "receptor"))


def long_pairs(wide: DataFrame, key: str = "pair", separator: str = "|") -> DataFrame:
    """(source, target, ligand, receptor, score) of a matrix with a row per pair and a column per ``source|target``; zeros, nulls and NaN are left out."""
    columns = [c for c in wide.columns if c != key and separator in c]
    if not columns:
        raise ParameterError(f"no column holds {separator}")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("between"), F.col(f"`{c}`").cast("double").alias("score")) for c in columns]))
    x = wide.select(parse_pair(F.col(key)).alias("p"), cells.alias("c")).select("p.*", "c.*").where("score is not null and not isnan(score) and score <> 0")
    side = F.split("between", f"\\Q{separator}\\E", 2)
    return x.select(side[0].alias("source"), side[1].alias("target"), "ligand", "receptor", "score")


def unit_ranks(scores: DataFrame, column: str = "score") -> DataFrame:
    """``scores`` with the column divided by its largest value where that is over one, so that ranks of any scale plot alike."""
    top = scores.agg(F.max(column).alias("_top"))
    return scores.join(F.broadcast(top)).withColumn(column, F.when(F.col("_top") > 1, F.col(column) / F.col("_top")).otherwise(F.col(column))).drop("_top")


def interaction_probability(expr: DataFrame, groups: DataFrame, pairs: DataFrame, half: float = 0.5, power: float = 1.0) -> DataFrame:
    """(source, target, ligand, receptor, probability): Hill function of the product of both sides' trimeans."""
    t = summaries(expr, groups).where("summary = 'trimean'").select("group", "gene_id", "value")
    lig = t.select(F.col("group").alias("source"), F.col("gene_id").alias("ligand"), F.col("value").alias("l"))
    rec = t.select(F.col("group").alias("target"), F.col("gene_id").alias("receptor"), F.col("value").alias("r"))
    lr = F.pow(F.col("l") * F.col("r"), F.lit(power))
    return pairs.join(lig, "ligand").join(rec, "receptor").select("source", "target", "ligand", "receptor", (lr / (F.lit(half**power) + lr)).alias("probability"))


def autocrine(scores: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs whose source is their target, by falling score."""
    own = scores.where("source = target and score > 0")
    return own.orderBy(F.col("score").desc(), "source", "ligand", "receptor").limit(n) if n else own


def combined_p(tests: DataFrame) -> DataFrame:
    """(source, target, ligand, receptor, p): Cauchy combination of the p-values of several summaries."""
    return tests.groupBy("source", "target", "ligand", "receptor").agg(stats.cauchy_combination(F.col("p")).alias("p"))


def summaries(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, gene_id, summary, value): mean, median, third quartile and trimean of each group's dense values.

    Zeros have no rows, so quantiles are read off the non-zeros at the shifted place, interpolated.
    """
    n = groups.groupBy("group").agg(F.count("*").alias("n"))
    x = expr.where("value > 0").join(groups.select("obs_id", "group"), "obs_id").join(F.broadcast(n), "group")
    a = x.groupBy("group", "gene_id", "n").agg(F.sort_array(F.collect_list("value")).alias("v"), F.sum("value").alias("s"))  # one group's non-zeros of one gene

    def at(p):
        h = (F.col("n") - 1) * F.lit(p)
        zeros = F.col("n") - F.size("v")
        pick = lambda i: F.when(i < zeros, 0.0).otherwise(F.get("v", (i - zeros).cast("int")))
        lo = F.floor(h)
        return pick(lo) + (h - lo) * (pick(F.least(lo + 1, F.col("n") - 1)) - pick(lo))

    named = {"mean": F.col("s") / F.col("n"), "median": at(0.5), "q3": at(0.75), "trimean": (at(0.25) + 2 * at(0.5) + at(0.75)) / 4}
    return a.select("group", "gene_id", F.explode(F.array(*[F.struct(F.lit(k).alias("summary"), v.alias("value")) for k, v in named.items()])).alias("e")).select("group", "gene_id", "e.summary", "e.value")


def parse_pair(name):
    """(ligand, receptor) of a pair's name: after the last colon, split once at ^, else _, else -."""
    tail = F.element_at(F.split(name, ":"), -1)
    split = F.when(F.contains(tail, F.lit("^")), F.split(tail, r"\^", 2)).when(F.contains(tail, F.lit("_")), F.split(tail, "_", 2)).otherwise(F.split(tail, "-", 2))
    return F.struct(F.get(split, F.lit(0)).alias("ligand"), F.get(split, F.lit(1)).alias("receptor"))


def circle_weights(scores: DataFrame) -> DataFrame:
    """(source, target, weight): sum of max(score) - score + 1 over the pairs between two groups."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.join(F.broadcast(top)).groupBy("source", "target").agg(F.sum(F.col("top") - F.col("score") + 1).alias("weight"))


def tile(scores: DataFrame) -> DataFrame:
    """(pair, cell_pair, score): mean by pair and pair of groups."""
    return scores.groupBy(F.concat_ws("_", "ligand", "receptor").alias("pair"), F.concat_ws("->", "source", "target").alias("cell_pair")).agg(F.avg("score").alias("score"))
