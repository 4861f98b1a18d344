"""Shared folder, lineage cuts and small helpers of the corpus operators."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.storage import shared_dir


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, tag)
    df.write.parquet(path)
    del df  # or its shuffle files stay
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done: it does so once their handles are collected as garbage."""
    for _ in range(2):  # the first round only tells the JVM which handles Python has dropped
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM's Hadoop API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60, used: list[str] | None = None) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps, each round written to the shared folder; the number of rounds is
    logarithmic in the longest path. Nodes without an edge do not appear. Null ends and loops are dropped.
    The path of the table that the result is read from is added to ``used``.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path_ = stored(small, "edges")
        n, total = new.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("long"))).first()
        remove(spark, path)
        e, path = new, new_path_
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if used is not None:
        used.append(path)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
