"""The annotated matrix as tables: observations, genes, long expression by layer, coordinates, graphs, results."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.errors import DataError, MissingDataError, ParameterError

#: Names under which a role may be stored, tried in this order.
ALTERNATIVES = {
    "spatial": ("spatial", "X_spatial", "coordinates", "coords"),
    "cell_type": ("cell_type", "celltype", "cell_types", "annotation"),
    "cluster": ("leiden", "louvain", "cluster", "clusters"),
    "batch": ("batch", "sample", "library_id", "dataset"),
}


@dataclass(frozen=True)
class SpatialData:
    """Immutable: every operator returns a new handle. ``expr`` is (obs_id, gene_id, layer, value) without zeros."""

    obs: DataFrame
    var: DataFrame
    expr: DataFrame
    coords: DataFrame | None = None
    graphs: dict[str, DataFrame] = field(default_factory=dict)
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    log: tuple[dict, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.obs.sparkSession

    def layers(self) -> set[str]:
        return {r[0] for r in self.expr.select("layer").distinct().collect()}

    def layer(self, name: str) -> DataFrame:
        return self.expr.where(F.col("layer") == name).select("obs_id", "gene_id", "value")

    def with_layer(self, name: str, values: DataFrame) -> SpatialData:
        rest = self.expr.where(F.col("layer") != name)
        return replace(self, expr=rest.unionByName(values.select("obs_id", "gene_id", F.lit(name).alias("layer"), F.col("value").cast("double").alias("value"))))

    def with_obs(self, columns: DataFrame) -> SpatialData:
        new = [c for c in columns.columns if c != "obs_id"]
        return replace(self, obs=self.obs.drop(*new).join(columns, "obs_id", "left"))

    def with_graph(self, name: str, edges: DataFrame, **params) -> SpatialData:
        """Graphs are kept by name and parameters, so that other parameters never meet an old graph."""
        return replace(self, graphs=self.graphs | {graph_key(name, **params): edges})

    def with_vectors(self, name: str, vectors: DataFrame) -> SpatialData:
        return replace(self, vectors=self.vectors | {name: vectors})

    def logged(self, analysis: str, method: str, parameters: dict, results: dict | None = None, statistics: dict | None = None) -> SpatialData:
        row = {"analysis": analysis, "method": method, "parameters": json.dumps(parameters, sort_keys=True, default=str), "results": json.dumps(results or {}, sort_keys=True), "statistics": json.dumps(statistics or {}, sort_keys=True, default=str)}
        return replace(self, log=(*(r for r in self.log if (r["analysis"], r["method"]) != (analysis, method)), row))

    def analysis_log(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.values()) for r in self.log], "analysis string, method string, parameters string, results string, statistics string")

    def has_layer(self, name: str) -> bool:
        return not self.expr.where(F.col("layer") == name).isEmpty()

    def has_graph(self, name: str, **params) -> bool:
        return graph_key(name, **params) in self.graphs

    def column(self, role: str) -> str:
        for name in ALTERNATIVES[role]:
            if name in self.obs.columns:
                return name
        raise MissingDataError(f"no column for {role}: one of {', '.join(ALTERNATIVES[role])} is needed")


def graph_key(name: str, **params) -> str:
    return name + "".join(f"|{k}={v}" for k, v in sorted(params.items()))


def is_integral(values: DataFrame) -> bool:
    off = values.agg(F.max(F.abs(F.col("value") - F.round("value")))).first()[0]
    return off is None or off < 1e-6


def resolve_layer(data: SpatialData, complete_genes: bool = True, require_counts: bool = False) -> str:
    """raw (if complete genes are preferred), then counts, then X; layers that are not integral are passed over only if counts are required."""
    have = data.layers()
    for name in (("raw",) if complete_genes else ()) + ("counts", "X"):
        if name in have and (not require_counts or is_integral(data.layer(name))):
            return name
    raise DataError("no layer with raw counts" if require_counts else "no expression layer")


def unique_names(names: DataFrame, column: str = "gene_id", order: str = "ord") -> DataFrame:
    """Second and later uses of a name get -1, -2, ... in row order, the next number where a name so made is taken. One task: a row per gene."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        taken, met, out = set(rows[column]), {}, []
        for name in rows[column]:
            if name not in met:
                met[name] = 0
                out.append(name)
                continue
            while True:
                met[name] += 1
                new = f"{name}-{met[name]}"
                if new not in taken:
                    break
            taken.add(new)
            out.append(new)
        return rows.drop(columns="_one").assign(**{column: out})

    return names.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, names.schema)


def after_load(data: SpatialData) -> SpatialData:
    """raw is what was loaded, if there is none; counts is a copy of raw."""
    have = data.layers()
    if "raw" not in have:
        data = data.with_layer("raw", data.layer("X"))
    return data if "counts" in have else data.with_layer("counts", data.layer("raw"))


def check_coordinates(coords: DataFrame) -> None:
    n, bad, sx, sy = coords.agg(F.count("*"), F.count_if(F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull() | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))), F.stddev_pop("x"), F.stddev_pop("y")).first()
    if not n:
        raise MissingDataError("no coordinates")
    if bad:
        raise DataError(f"{bad} coordinates are missing or not finite")
    if sx == 0 and sy == 0:
        raise DataError("all coordinates are the same")


def check_basics(data: SpatialData, least_obs: int = 1, least_genes: int = 1) -> None:
    """Enough observations and genes; at most a tenth of observations and half of genes without any value."""
    n, m = data.obs.count(), data.var.count()
    if n < least_obs or m < least_genes:
        raise DataError(f"{n} observations and {m} genes; at least {least_obs} and {least_genes} are needed")
    used, seen = data.expr.where("value <> 0").agg(F.countDistinct("obs_id"), F.countDistinct("gene_id")).first()
    if used < 0.9 * n or seen < 0.5 * m:
        raise DataError(f"{n - used} observations and {m - seen} genes hold nothing")


def check_velocity_layers(data: SpatialData) -> None:
    for name in ("spliced", "unspliced"):
        n, total, bad = data.layer(name).agg(F.count("*"), F.sum("value"), F.count_if(F.isnan("value"))).first()
        if not n or not total or bad:
            raise MissingDataError(f"layer {name} is absent, empty or holds NaN")


def resolve_feature(data: SpatialData, name: str, layer: str | None = None) -> DataFrame:
    """(obs_id, value) of a gene, else of a column of observations, else of a vector's component (``name_2`` is the third of ``name``).

    A gene's zeros are filled; an error names what was looked through.
    """
    if not data.var.where(F.col("gene_id").cast("string") == name).isEmpty():
        values = data.layer(layer or resolve_layer(data)).where(F.col("gene_id").cast("string") == name)
        return data.obs.select("obs_id").join(values.select("obs_id", "value"), "obs_id", "left").na.fill(0.0, ["value"])
    if name in data.obs.columns:
        return data.obs.select("obs_id", F.col(name).alias("value"))
    stem, _, at = name.rpartition("_")
    if stem in data.vectors and at.isdigit():
        return data.vectors[stem].select("obs_id", F.get("v", F.lit(int(at))).alias("value"))
    raise MissingDataError(f"{name} is no gene, column ({', '.join(data.obs.columns)}) or vector component ({', '.join(sorted(data.vectors))})")


def categorical_columns(data: SpatialData, most: int = 100) -> list[str]:
    """Columns of observations that are text, or numbers of at most ``most`` values, from one pass."""
    columns = [c for c in data.obs.columns if c != "obs_id"]
    if not columns:
        return []
    n = data.obs.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    kinds = dict(data.obs.dtypes)
    return [c for i, c in enumerate(columns) if kinds[c] in ("string", "boolean") or (kinds[c] in ("int", "bigint") and n[f"n{i}"] <= most)]


def select_genes(data: SpatialData, wanted: list[str] | None = None, n: int = 20) -> DataFrame:
    """The wanted genes that exist (an error names close ones if none does), else the first n variable genes."""
    if wanted:
        names = data.spark.createDataFrame([(w,) for w in wanted], "gene_id string")
        have = data.var.select(F.col("gene_id").cast("string").alias("gene_id"))
        found = names.join(have, "gene_id", "left_semi")
        if found.isEmpty():
            near = have.join(F.broadcast(names.withColumnRenamed("gene_id", "w"))).orderBy(F.levenshtein("gene_id", "w"), "gene_id").limit(5)
            raise MissingDataError(f"none of {', '.join(wanted)} is a gene; close: {', '.join(r[0] for r in near.select('gene_id').collect())}")
        return found
    if "highly_variable" not in data.var.columns:
        raise ParameterError("name genes or find variable genes first")
    return data.var.where("highly_variable").orderBy("gene_id").limit(n).select("gene_id")
