"""Spatial domains: communities of a graph that joins expression and space, then smoothed labels."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.errors import ParameterError
from cellweave.operators import embedding, neighbors, spatial
from cellweave.storage import cut


def spatial_domains(vectors: DataFrame, points: DataFrame, k: int = 6, spatial_weight: float = 0.3, resolution: float = 0.5, refine: bool = True, threshold: float = 0.5) -> DataFrame:
    """(obs_id, domain, refined): communities of (1 - w) times the expression graph plus w times the spatial graph; a weight of 0 means no space at all.

    ``vectors`` is (obs_id, v), ``points`` (obs_id, x, y); refinement takes the majority of ten nearest points where most differ.
    """
    if not 0 <= spatial_weight <= 1:
        raise ParameterError("spatial_weight must lie between 0 and 1")
    expression = neighbors.row_standardised(neighbors.vector_knn(vectors.select("obs_id", "v"), k).select("src", "dst"))
    space = neighbors.row_standardised(neighbors.knn(points, k).select("src", "dst"))
    edges = neighbors.combined(expression, space, spatial_weight).where("w > 0")
    found = embedding.communities(edges, points, resolution).withColumnRenamed("cluster", "label")
    if not refine:
        return found.select("obs_id", F.col("label").alias("domain"), F.col("label").alias("refined"))
    near = neighbors.knn(points, 10, include_self=True)
    return spatial.refine_labels(near, found, threshold).select("obs_id", F.col("label").alias("domain"), "refined")


def group_closeness(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, closeness): the nodes outside a group over the sum of their distances to it (those out of reach add nothing; 0 if all are).

    One frontier per group, widened by joins until none moves.
    """
    und = neighbors.symmetric(edges)
    step = cut(und.select(F.col("a").alias("obs_id"), F.col("b").alias("to")).unionByName(und.select(F.col("b").alias("obs_id"), F.col("a").alias("to"))))
    seen = cut(labels.select("label", "obs_id", F.lit(0).alias("hops")))
    front = seen
    for depth in count(1):
        front = cut(front.join(step, "obs_id").select("label", F.col("to").alias("obs_id")).distinct().join(seen.select("label", "obs_id"), ["label", "obs_id"], "left_anti").withColumn("hops", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    n = labels.agg(F.count("*").alias("n"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    far = seen.groupBy("label").agg(F.sum("hops").alias("far"))
    return size.join(far, "label").join(F.broadcast(n)).select("label", F.when(F.col("far") > 0, (F.col("n") - F.col("size")) / F.col("far")).otherwise(0.0).alias("closeness"))


def group_centrality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, degree_centrality, clustering): share of outside nodes next to the group, and the mean clustering of its nodes."""
    und = neighbors.symmetric(edges)
    both = und.select(F.col("a").alias("obs_id"), F.col("b").alias("other")).unionByName(und.select(F.col("b").alias("obs_id"), F.col("a").alias("other")))
    own = labels.select("obs_id", "label")
    touched = both.join(own, "obs_id").join(own.select(F.col("obs_id").alias("other"), F.col("label").alias("theirs")), "other").where("label <> theirs").groupBy("label").agg(F.countDistinct("other").alias("touched"))
    n = own.agg(F.count("*").alias("n"))
    size = own.groupBy("label").agg(F.count("*").alias("size"))
    c = own.join(neighbors.clustering(edges).select("obs_id", "clustering"), "obs_id", "left").na.fill(0.0, ["clustering"]).groupBy("label").agg(F.avg("clustering").alias("clustering"))
    out = size.join(F.broadcast(n)).join(touched, "label", "left").na.fill(0, ["touched"]).join(c, "label")
    return out.select("label", F.when(F.col("n") > F.col("size"), F.col("touched") / (F.col("n") - F.col("size"))).otherwise(0.0).alias("degree_centrality"), "clustering")
