"""Spatial tables over the driver's star schema, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **named: str):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = "WITH " + ",\n".join(_needed(sql)) + "\n" + sql if _needed(sql) else sql
        return fn

    return keep


def sql_normal_p(z: str) -> str:
    """Two-sided normal p in SQL: Simpson's rule on the density from |z| to |z| + 8."""
    return f"(2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(abs({z}) + i * 0.002, 2) / 2))) * 0.002 / 3)"


def sql_student_p(t: str, v: str) -> str:
    """Two-sided p of Student's t in SQL: Simpson's rule on the power of the cosine that the law is in terms of the angle, over the fourth root of the angle left."""
    side = f"power(pi() / 2 - atan(abs({t}) / sqrt({v})), 0.25)"
    at = f"(i * {side} / 4000)"
    sums = f"list_sum(list_transform(range(1, 4001), lambda i: (CASE WHEN i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 4 * power({at}, 3) * power(sin(power({at}, 4)), {v} - 1)))"
    return f"(2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - ln(pi()) / 2) * {sums} * {side} / 12000)"


def sql_bh(p: str, by: str, order: str) -> tuple[str, str]:
    """(inner, outer) SQL columns of Benjamini-Hochberg's q: step and place inside a subquery, q over it."""
    part = f"PARTITION BY {by} " if by else ""
    inner = f"least(1, {p} * count(*) OVER ({part}) / row_number() OVER ({part}ORDER BY {p}, {order})) AS step_, row_number() OVER ({part}ORDER BY {p}, {order}) AS place_"
    return inner, f"min(step_) OVER ({part}ORDER BY place_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name or (c if isinstance(c, str) else "value"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("obs_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("cluster"))


def spot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense (obs_id, gene_id, value), genes 2 to 63."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("gene_id", "value"))
    return e.where("gene_id >= 2").withColumn("value", F.col("value").cast("double"))


def spot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("obs_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("label") % 3).alias("batch"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("obs_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of ``counts`` with a group of five."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obs_id"), (F.col("s_suppkey") % 5).alias("group"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), F.col("p_type").alias("chromosome"), F.col("p_partkey").alias("pos"), (F.col("p_type") == "PROMO").alias("mt"), (F.col("p_type") == "SMALL").alias("ribo"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations: sample is the customer's nation, condition its region."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("cell_type"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sample"))
    n = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample"), F.col("n_regionkey").alias("condition")))  # 25 nations
    return o.join(c, "c_custkey").join(n, "sample").select("obs_id", "sample", "condition", "cell_type")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    status = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0.0))
    return li.groupBy(F.col("l_suppkey").alias("obs_id"), F.col("l_partkey").alias("gene_id")).agg(status("F").alias("spliced"), status("O").alias("unspliced"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligand-receptor pairs of neighbouring spot genes."""
    return spark.range(2, 63).select(F.col("id").cast("int").alias("ligand"), (F.col("id") + 1).cast("int").alias("receptor"))


def count_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part")
    return g.select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") + 1).alias("receptor")).join(g.select(F.col("p_partkey").alias("receptor")), "receptor", "left_semi").select("ligand", "receptor")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker sets over spot genes: seven types of overlapping thirds."""
    g = spark.range(2, 64).select(F.col("id").cast("int").alias("gene_id"))
    t = g.select("gene_id", F.explode(F.array((F.col("gene_id") % 7), F.col("gene_id") % 3)).alias("t"))
    return t.select(F.concat(F.lit("type"), F.col("t").cast("string")).alias("cell_type"), "gene_id").distinct().withColumn("direction", F.when(F.col("gene_id") % 5 == 0, -1).otherwise(1))


#: The same tables for DuckDB, in an order in which each uses only those before it.
SQL = {
    "spots": "SELECT vec_id AS obs_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS cluster FROM embeddings",
    "vals": "SELECT vec_id AS obs_id, CAST(g AS INTEGER) AS gene_id, CAST(embedding[g + 1] AS DOUBLE) AS value FROM embeddings, range(2, 64) t(g)",
    "vecs": "SELECT vec_id AS obs_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label % 3 AS batch FROM embeddings",
    "counts": "SELECT l_suppkey AS obs_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2",
    "ocounts": "SELECT l_orderkey AS obs_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2",
    "cells": "SELECT s_suppkey AS obs_id, s_suppkey % 5 AS grp FROM supplier",
    "genes": "SELECT p_partkey AS gene_id, p_name AS name, p_brand AS set_name, p_type AS chromosome, p_partkey AS pos, p_type = 'PROMO' AS mt, p_type = 'SMALL' AS ribo FROM part",
    "samples": "SELECT o_orderkey AS obs_id, c_nationkey AS sample, n_regionkey AS condition, o_orderpriority AS cell_type FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey",
    "layers": "SELECT l_suppkey AS obs_id, l_partkey AS gene_id, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS spliced, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS unspliced FROM lineitem GROUP BY 1, 2",
    "lr": "SELECT CAST(g AS INTEGER) AS ligand, CAST(g + 1 AS INTEGER) AS receptor FROM range(2, 63) t(g)",
    "clr": "SELECT a.p_partkey AS ligand, b.p_partkey AS receptor FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "markers": "SELECT DISTINCT 'type' || CAST(t AS VARCHAR) AS cell_type, gene_id, CASE WHEN gene_id % 5 = 0 THEN -1 ELSE 1 END AS direction FROM (SELECT CAST(g AS INTEGER) AS gene_id, g % 7 AS t FROM range(2, 64) r(g) UNION ALL SELECT CAST(g AS INTEGER), g % 3 FROM range(2, 64) r(g))",
    "nn": "SELECT src, dst, sqrt(d2) AS d, rank FROM (SELECT a.obs_id AS src, b.obs_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.obs_id) AS rank FROM spots a JOIN spots b ON a.obs_id <> b.obs_id) WHERE rank <= 6",
    "und": "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nn",
    "zs": "SELECT obs_id, gene_id, value, value - avg(value) OVER (PARTITION BY gene_id) AS z FROM vals",
    "moments": "SELECT (SELECT count(*)::DOUBLE FROM nn) AS s0, (SELECT sum(t * t) / 2.0 FROM (SELECT coalesce(e.w, 0) + coalesce(r.w, 0) AS t FROM (SELECT src, dst, 1.0 AS w FROM nn) e FULL JOIN (SELECT dst AS src, src AS dst, 1.0 AS w FROM nn) r ON e.src = r.src AND e.dst = r.dst)) AS s1, (SELECT sum(d * d) FROM (SELECT i, sum(1.0) AS d FROM (SELECT src AS i FROM nn UNION ALL SELECT dst FROM nn) GROUP BY i)) AS s2",
    "lag": "SELECT src AS obs_id, gene_id, avg(z) AS lag FROM nn JOIN zs ON zs.obs_id = nn.dst GROUP BY 1, 2",
    "lognorm": "SELECT c.obs_id, c.gene_id, ln(1 + c.value * (SELECT median(t) FROM (SELECT sum(value) AS t FROM counts GROUP BY obs_id)) / t.t) AS value FROM counts c JOIN (SELECT obs_id, sum(value) AS t FROM counts GROUP BY obs_id) t ON c.obs_id = t.obs_id",
    "gmom": "SELECT gene_id, grp, n1, n2, s1 / n1 AS m1, greatest(0, (q1 - s1 * s1 / n1) / (n1 - 1)) AS v1, (s - s1) / n2 AS m2, greatest(0, (q - q1 - (s - s1) * (s - s1) / n2) / (n2 - 1)) AS v2 FROM (SELECT t.gene_id, g.grp, n1, n_all - n1 AS n2, coalesce(s1, 0) AS s1, coalesce(q1, 0) AS q1, s, q FROM (SELECT gene_id, sum(value) AS s, sum(value * value) AS q FROM lognorm GROUP BY 1) t CROSS JOIN (SELECT grp, count(*) AS n1, (SELECT count(*) FROM cells) AS n_all FROM cells GROUP BY 1) g LEFT JOIN (SELECT gene_id, grp, sum(value) AS s1, sum(value * value) AS q1 FROM lognorm JOIN cells USING (obs_id) GROUP BY 1, 2) x ON x.gene_id = t.gene_id AND x.grp = g.grp)",
    "bulk": "SELECT sample, condition, gene_id, sum(value) AS value FROM ocounts JOIN samples USING (obs_id) GROUP BY 1, 2, 3",
    "factors": "SELECT sample, exp(lf - avg(lf) OVER ()) AS size_factor FROM (SELECT sample, median(ln(value) - lg) AS lf FROM bulk JOIN (SELECT gene_id, sum(ln(value)) / (SELECT count(DISTINCT sample) FROM bulk) AS lg FROM bulk WHERE value > 0 GROUP BY 1) USING (gene_id) WHERE value > 0 GROUP BY 1)",
    "scaled": "SELECT obs_id, gene_id, greatest(-10.0, least(10.0, (value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END)) AS value FROM vals WINDOW w AS (PARTITION BY gene_id)",
    "lrm": "SELECT cluster AS grp, gene_id, avg(value) AS mean, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS fraction FROM vals JOIN spots USING (obs_id) GROUP BY 1, 2",
    "lrs": "SELECT l.grp AS source, r.grp AS target, ligand, receptor, (l.mean + r.mean) / 2 AS score FROM lr JOIN lrm l ON l.gene_id = ligand AND l.fraction >= 0.1 JOIN lrm r ON r.gene_id = receptor AND r.fraction >= 0.1",
    "ranked": "SELECT gene_id, score, row_number() OVER (ORDER BY score DESC, gene_id) AS pos FROM (SELECT gene_id, (sa / na - sb / nb) / (greatest(sqrt(greatest(0, qa / na - sa / na * sa / na)), 0.2 * CASE WHEN sa = 0 THEN 1 ELSE abs(sa / na) END) + greatest(sqrt(greatest(0, qb / nb - sb / nb * sb / nb)), 0.2 * CASE WHEN sb = 0 THEN 1 ELSE abs(sb / nb) END)) AS score FROM (SELECT gene_id, sum(CASE WHEN grp = 0 THEN value ELSE 0 END) AS sa, sum(CASE WHEN grp = 0 THEN value * value ELSE 0 END) AS qa, sum(CASE WHEN grp = 1 THEN value ELSE 0 END) AS sb, sum(CASE WHEN grp = 1 THEN value * value ELSE 0 END) AS qb, (SELECT count(*) FROM cells WHERE grp = 0)::DOUBLE AS na, (SELECT count(*) FROM cells WHERE grp = 1)::DOUBLE AS nb FROM lognorm JOIN cells USING (obs_id) GROUP BY 1))",
    "props": "SELECT obs_id, 'ct' || CAST(gene_id % 6 AS VARCHAR) AS cell_type, sum(value) / sum(sum(value)) OVER (PARTITION BY obs_id) AS proportion FROM counts GROUP BY obs_id, 2",
    "profile": "SELECT obs_id, chromosome, (i - full_len) // 10 AS bin, cnv FROM (SELECT obs_id, chromosome, i, least(30, len) AS full_len, avg(lfc) OVER (PARTITION BY obs_id, chromosome ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS cnv FROM (SELECT obs_id, chromosome, i, len, greatest(-3, least(3, value - base)) AS lfc FROM (SELECT obs_id, gene_id, value, avg(CASE WHEN obs_id % 5 = 0 THEN value END) OVER (PARTITION BY gene_id) AS base FROM vals) JOIN (SELECT gene_id, chromosome, row_number() OVER (PARTITION BY chromosome ORDER BY gene_id) AS i, count(*) OVER (PARTITION BY chromosome) AS len FROM (SELECT CAST(g AS INTEGER) AS gene_id, 'chr' || CAST(CASE WHEN g < 40 THEN 1 ELSE 2 END AS VARCHAR) AS chromosome FROM range(2, 64) t(g))) USING (gene_id))) WHERE i >= full_len AND (i - full_len) % 10 = 0",
    "cnv": "SELECT obs_id, chromosome, CAST(bin AS INTEGER) AS bin, CASE WHEN abs(cnv) < 1.5 * stddev_pop(cnv) OVER () THEN 0 ELSE cnv END AS cnv FROM (SELECT obs_id, chromosome, bin, cnv - quantile_cont(cnv, 0.5) OVER (PARTITION BY obs_id) AS cnv FROM profile)",
}


def _needed(sql: str) -> list[str]:
    """Definitions of the tables that ``sql`` names, with those that they name."""
    import re

    text, found = sql, []
    for name in reversed(SQL):
        if re.search(rf"\b{name}\b", text):
            found.append(f"{name} AS MATERIALIZED ({SQL[name]})")
            text += f" {SQL[name]}"
    return found[::-1]
