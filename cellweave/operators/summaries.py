"""Short summaries of spatial results: one row each, the same four columns whatever the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.errors import ParameterError

TOP = 10


def _row(df: DataFrame, n: Column, significant: Column, top: Column, **metrics: Column) -> DataFrame:
    named = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[c.cast("double") for c in metrics.values()]))
    return df.agg(n.cast("long").alias("n_features"), significant.cast("long").alias("n_significant"), F.slice(top, 1, TOP).alias("top_features"), named.alias("metrics"))


def _by(score: Column, name: Column) -> Column:
    """Names by falling score, then by name, as text."""
    ordered = F.array_sort(F.collect_list(F.struct((-score).alias("a"), name.alias("b"))))  # a row per gene, group or pair
    return F.transform(ordered, lambda s: s["b"].cast("string"))


def summary(analysis: str, result: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(n_features, n_significant, top_features, metrics) of the rows an operator returned; metrics is a map of numbers.

    Analyses: moran, geary, bivariate_moran (pairs over 0.3 count as significant), local_moran (``lisa_summary``), getis_ord
    (``getis_summary``), neighbourhood (z-scores), co_occurrence, ripley, centrality (a row per label), join_count (``join_count_p``),
    local_join_count (``local_join_summary``), network. An unknown analysis is a ParameterError.
    """
    none, zero = F.array().cast("array<string>"), F.lit(0)
    c, gene = F.col, F.col("gene_id") if "gene_id" in result.columns else None
    if analysis == "moran":
        return _row(result, F.count("*"), F.count_if(c("p") < alpha), _by(c("moran_i"), gene), mean_moran_i=F.avg("moran_i"))
    if analysis == "geary":
        return _row(result, F.count("*"), zero, none, mean_geary_c=F.avg("geary_c"))
    if analysis == "local_moran":
        return _row(result, F.count("*"), F.sum("n_significant"), _by(F.lit(0), gene), mean_hotspots=F.avg("n_hotspots"), mean_coldspots=F.avg("n_coldspots"))
    if analysis == "getis_ord":
        return _row(result, F.count("*"), zero, _by(F.lit(0), gene), total_hotspots=F.sum("n_hot"), total_coldspots=F.sum("n_cold"))
    if analysis == "bivariate_moran":
        name = F.concat_ws("_vs_", c("gene_x").cast("string"), c("gene_y").cast("string"))
        return _row(result, F.count("*"), F.count_if(F.abs("moran_xy") > 0.3), _by(F.lit(0), name), mean_bivariate_i=F.avg("moran_xy"))
    if analysis == "neighbourhood":
        return _row(result, F.countDistinct("label_a"), zero, none, max_enrichment=F.max("zscore"), min_enrichment=F.min("zscore"))
    if analysis in ("co_occurrence", "ripley", "centrality"):
        return _row(result, F.countDistinct("label_a" if "label_a" in result.columns else "label"), zero, none)
    if analysis == "join_count":
        return _row(result, F.lit(2), F.count_if(c("p_bb") < alpha), none, bb=F.max("bb"), ww=F.max("ww"), bw=F.max("bw"), total=F.max("j"), p=F.max("p_bb"))
    if analysis == "local_join_count":
        return _row(result, F.count("*"), F.sum("n_significant"), _by(F.lit(0), c("label")), total_significant=F.sum("n_significant"))
    if analysis == "network":
        numbers = [n for n, kind in result.dtypes if kind in ("int", "bigint", "double")]
        return _row(result, zero, zero, none, **{n: F.max(n) for n in numbers})
    raise ParameterError(f"no summary for {analysis}")
