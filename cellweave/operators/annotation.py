"""Cell types from marker tables and reference profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.errors import DependencyError

UNKNOWN = "Unknown"


def marker_scores(scaled: DataFrame, markers: DataFrame) -> DataFrame:
    """(obs_id, cell_type, score) from scaled values and markers (cell_type, gene_id, direction in 1, -1).

    A marker weighs more the fewer types share it; score is the weighted sum of positive markers over the root of their
    number, less that of the negative ones.
    """
    pos = markers.where("direction > 0")
    freq = pos.groupBy("gene_id").agg(F.countDistinct("cell_type").alias("f"))
    every = Window.partitionBy(F.lit(0))
    lo, hi = F.min("f").over(every), F.max("f").over(every)
    freq = freq.select("gene_id", F.when(hi > lo, 1.0 - (F.col("f") - lo) / (hi - lo)).otherwise(1.0).alias("weight"))
    m = markers.join(freq, "gene_id", "left").na.fill(1.0, ["weight"])
    present = m.join(scaled.select("gene_id").distinct(), "gene_id", "left_semi")
    n = present.groupBy("cell_type").agg(F.count_if(F.col("direction") > 0).alias("np"), F.count_if(F.col("direction") < 0).alias("nn"))
    x = scaled.join(present, "gene_id")
    s = x.groupBy("obs_id", "cell_type").agg(F.sum(F.when(F.col("direction") > 0, F.col("value") * F.col("weight")).otherwise(0.0)).alias("sp"), F.sum(F.when(F.col("direction") < 0, F.col("value")).otherwise(0.0)).alias("sn"))
    s = s.join(F.broadcast(n), "cell_type")
    return s.select("obs_id", "cell_type", (F.when(F.col("np") > 0, F.col("sp") / F.sqrt("np")).otherwise(0.0) - F.when(F.col("nn") > 0, F.col("sn") / F.sqrt("nn")).otherwise(0.0)).alias("score"))


def assign(scores: DataFrame) -> DataFrame:
    """(obs_id, cell_type, confidence): the best type, Unknown where no score is positive; confidence is its softmax share, 0 for Unknown."""
    w = Window.partitionBy("obs_id")
    s = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    best = s.groupBy("obs_id").agg(F.max("score").alias("top"), F.min_by("cell_type", F.struct((-F.col("score")).alias("a"), F.col("cell_type").alias("b"))).alias("type"), (F.max("e") / F.sum("e")).alias("share"))
    return best.select("obs_id", F.when(F.col("top") > 0, F.col("type")).otherwise(UNKNOWN).alias("cell_type"), F.when(F.col("top") > 0, F.col("share")).otherwise(0.0).alias("confidence"))


def confidence_by_type(assigned: DataFrame, digits: int = 3) -> DataFrame:
    return assigned.groupBy("cell_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), digits).alias("confidence"))


def map_clusters(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """(obs_id, cell_type): a broadcast look-up of (cluster, cell_type); clusters without a name are Unknown."""
    return clusters.join(F.broadcast(names), "cluster", "left").select("obs_id", F.coalesce("cell_type", F.lit(UNKNOWN)).alias("cell_type"))


def spearman_reference(dense: DataFrame, profiles: DataFrame) -> DataFrame:
    """(obs_id, cell_type, rho): Spearman correlation of each cell with each reference profile (cell_type, gene_id, value) over shared genes."""
    from cellweave.functions.stats import average_rank

    genes = profiles.select("gene_id").distinct()
    a = dense.join(genes, "gene_id", "left_semi").withColumn("ra", average_rank("value", ("obs_id",)))
    shared = dense.select("gene_id").distinct()
    b = profiles.join(shared, "gene_id", "left_semi").withColumn("rb", average_rank("value", ("cell_type",)))
    return a.select("obs_id", "gene_id", "ra").join(b.select("cell_type", "gene_id", "rb"), "gene_id").groupBy("obs_id", "cell_type").agg(F.corr("ra", "rb").alias("rho"))


def marker_size_factors(expr: DataFrame) -> DataFrame:
    """(obs_id, size_factor): total over the mean total."""
    t = expr.groupBy("obs_id").agg(F.sum("value").alias("t"))
    return t.join(F.broadcast(t.agg(F.avg("t").alias("m")))).select("obs_id", (F.col("t") / F.col("m")).alias("size_factor"))


def learned_model(*_, **__):
    raise DependencyError("this annotator needs torch or a language model; use marker_scores, marker_mixture or spearman_reference")
