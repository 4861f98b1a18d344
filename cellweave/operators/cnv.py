"""Copy-number profiles by running means along the chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.errors import DependencyError


def infer(dense: DataFrame, genes: DataFrame, reference: DataFrame, window: int = 100, step: int = 10, clip: float = 3.0, dynamic: float | None = 1.5, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(obs_id, chromosome, bin, cnv) from dense log values and genes (gene_id, chromosome, pos).

    Values less the mean of the reference cells, clipped, averaged over ``window`` genes in chromosome order (where the window is full, or over the whole of a shorter chromosome),
    every ``step``-th kept; each cell's median goes, and what lies within ``dynamic`` standard deviations of all becomes 0.
    """
    g = genes.where(~F.col("chromosome").isin(*exclude)) if exclude else genes
    g = g.withColumns({"i": F.row_number().over(Window.partitionBy("chromosome").orderBy("pos", "gene_id")), "len": F.count("*").over(Window.partitionBy("chromosome"))})
    base = dense.join(reference.select("obs_id"), "obs_id", "left_semi").groupBy("gene_id").agg(F.avg("value").alias("base"))
    x = dense.join(F.broadcast(base), "gene_id").join(F.broadcast(g.select("gene_id", "chromosome", "i", "len")), "gene_id")
    x = x.withColumn("lfc", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("value") - F.col("base"))))
    w = Window.partitionBy("obs_id", "chromosome").orderBy("i").rowsBetween(-(window - 1), 0)
    full = F.least(F.lit(window), F.col("len"))
    b = x.withColumn("cnv", F.avg("lfc").over(w)).where((F.col("i") >= full) & ((F.col("i") - full) % step == 0))
    b = b.withColumn("bin", ((F.col("i") - full) / step).cast("int"))
    b = b.withColumn("cnv", F.col("cnv") - F.percentile("cnv", F.lit(0.5)).over(Window.partitionBy("obs_id")))
    if dynamic is not None:
        bar = b.agg((F.stddev_pop("cnv") * dynamic).alias("bar"))
        b = b.join(F.broadcast(bar)).withColumn("cnv", F.when(F.abs("cnv") < F.col("bar"), 0.0).otherwise(F.col("cnv")))
    return b.select("obs_id", "chromosome", "bin", "cnv")


def cell_scores(profile: DataFrame) -> DataFrame:
    """(obs_id, score): mean |cnv|."""
    return profile.groupBy("obs_id").agg(F.avg(F.abs("cnv")).alias("score"))


def statistics(profile: DataFrame) -> DataFrame:
    """One row: mean, population sd and true median of all bins."""
    return profile.agg(F.avg("cnv").alias("mean"), F.stddev_pop("cnv").alias("sd"), F.median("cnv").alias("median"), F.countDistinct("obs_id").alias("n_cells"))


def by_group(profile: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, chromosome, bin, cnv): group means, the data of a heat map."""
    return profile.join(groups.select("obs_id", "group"), "obs_id").groupBy("group", "chromosome", "bin").agg(F.avg("cnv").alias("cnv"))


def reference_cells(groups: DataFrame, names: list) -> DataFrame:
    """The cells of the reference groups; an error names those that no cell has."""
    from cellweave.operators.markers import in_groups

    return in_groups(groups, names).select("obs_id")


def clusters(profile: DataFrame, obs: DataFrame, k: int = 15, resolution: float = 1.0) -> DataFrame:
    """(obs_id, cluster): communities of the kNN graph of the cells' profiles."""
    from cellweave.operators import embedding, neighbors

    v = profile.groupBy("obs_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chromosome", "bin", "cnv"))), lambda s: s["cnv"]).alias("v"))
    return embedding.communities(neighbors.vector_knn(v, k).select("src", "dst"), obs, resolution)


def haplotype_model(*_, **__):
    raise DependencyError("the haplotype-aware model needs R; use infer for expression-based profiles")
