"""What is in a table: column and gene profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def columns(df: DataFrame, skip: tuple[str, ...] = ("obs_id",)) -> DataFrame:
    """(column, kind, n_unique, min, max, samples): numbers give a range; others the first values, five, or three of over a hundred. One pass."""
    rows = []
    for name, kind in df.dtypes:
        if name in skip:
            continue
        numeric = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
        rows.append((name, numeric))
    aggs = []
    for i, (name, numeric) in enumerate(rows):
        c = F.col(name)
        aggs.append(F.countDistinct(c).alias(f"n{i}"))
        if numeric:
            aggs += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
    text = [name for name, numeric in rows if not numeric]
    if text:  # the first five values of every text column from one scan
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in text])).alias("p")).select("p.*").where("v is not null").distinct()
        first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("v"))).where("r <= 5").groupBy("c").agg(F.array_sort(F.collect_list("v")).alias("s"))
    one = df.agg(*aggs)
    parts = []
    for i, (name, numeric) in enumerate(rows):
        if numeric:
            parts.append(one.select(F.lit(name).alias("column"), F.lit("numeric").alias("kind"), F.col(f"n{i}").alias("n_unique"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")))
        else:
            parts.append(one.select(F.lit(name).alias("column"), F.lit("categorical").alias("kind"), F.col(f"n{i}").alias("n_unique"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max")))
    out = reduce(DataFrame.unionByName, parts)
    if not text:
        return out.withColumn("samples", F.lit(None).cast("string"))
    shown = F.array_join(F.when(F.col("n_unique") > 100, F.slice("s", 1, 3)).otherwise(F.col("s")), "|")
    return out.join(first, F.col("column") == F.col("c"), "left").withColumn("samples", shown).drop("c", "s")


def top_expressed(expr: DataFrame, n_obs: int, n: int = 10) -> DataFrame:
    """(gene_id, mean) of the n genes of highest mean, zeros included."""
    return expr.groupBy("gene_id").agg((F.sum("value") / n_obs).alias("mean")).orderBy(F.col("mean").desc(), "gene_id").limit(n)


def top_variable(genes: DataFrame, n: int = 10) -> list:
    """The ids of the first ``n`` variable genes, by hvg_rank where there is one, else by falling norm_dispersion, else by id; empty if none are flagged."""
    if "highly_variable" not in genes.columns:
        return []
    order = [F.col("hvg_rank")] if "hvg_rank" in genes.columns else [F.col("norm_dispersion").desc()] if "norm_dispersion" in genes.columns else []
    return [r[0] for r in genes.where("highly_variable").orderBy(*order, "gene_id").select("gene_id").limit(n).collect()]


def dataset(data) -> dict:
    """What is in a dataset: sizes, layers, graphs, vectors, the profile of its columns, and its most expressed and most variable genes."""
    n = data.obs.count()
    main = next((x for x in ("X", "counts", "raw") if x in data.layers()), None)
    return {
        "n_obs": n,
        "n_genes": data.var.count(),
        "layers": sorted(data.layers()),
        "graphs": sorted(data.graphs),
        "vectors": sorted(data.vectors),
        "spatial": data.coords is not None,
        "columns": [r.asDict() for r in columns(data.obs).orderBy("column").collect()] if len(data.obs.columns) > 1 else [],
        "top_expressed": [r[0] for r in top_expressed(data.layer(main), n).collect()] if main and n else [],
        "top_variable": top_variable(data.var),
        "analyses": [(r["analysis"], r["method"]) for r in data.log],
    }


def name_share(genes: DataFrame, pattern: str) -> DataFrame:
    """One row (n, share): genes whose name matches, as a warning about housekeeping genes."""
    return genes.agg(F.count_if(F.col("name").rlike(pattern)).alias("n"), F.avg(F.when(F.col("name").rlike(pattern), 1.0).otherwise(0.0)).alias("share"))
