"""Writers: whole datasets, result tables, the analysis log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.errors import MissingDataError
from cellweave.model import SpatialData


def save(data: SpatialData, path: str) -> None:
    """One parquet table per slot; expression is partitioned by layer and clustered by gene, so that gene filters prune row groups."""
    data.obs.write.mode("overwrite").parquet(f"{path}/obs")
    data.var.write.mode("overwrite").parquet(f"{path}/var")
    data.expr.repartitionByRange("layer", "gene_id").sortWithinPartitions("layer", "gene_id").write.mode("overwrite").partitionBy("layer").parquet(f"{path}/expr")
    if data.coords is not None:
        data.coords.write.mode("overwrite").parquet(f"{path}/coords")
    for kind, tables in (("graphs", data.graphs), ("vectors", data.vectors)):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
    if data.log:
        data.analysis_log().write.mode("overwrite").parquet(f"{path}/analysis_log")


def wide(vectors: DataFrame, prefix: str, size: int) -> DataFrame:
    """(obs_id, prefix_0, prefix_1, ...) from (obs_id, v)."""
    return vectors.select("obs_id", *[F.col("v")[i].alias(f"{prefix}_{i}") for i in range(size)])


def matching(table: DataFrame, key: str, id_column: str = "obs_id") -> DataFrame:
    """The id and the columns whose name holds ``key``."""
    found = [c for c in table.columns if key in c and c != id_column]
    if not found:
        raise MissingDataError(f"no column holds {key}")
    return table.select(id_column, *found)


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of one CSV file, for result tables (not for expression)."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def export_results(data: SpatialData, results: dict[str, DataFrame], path: str, dataset: str, analysis: str, method: str) -> DataFrame:
    """Writes each result to path/dataset/analysis/method_key and returns the index (key, path)."""
    rows = []
    for key, df in sorted(results.items()):
        to = f"{path}/{dataset}/{analysis}/{method}_{key}"
        export_csv(df, to)
        rows.append((dataset, analysis, method, key, to))
    index = data.spark.createDataFrame(rows, "dataset string, analysis string, method string, key string, path string")
    index.write.mode("append").json(f"{path}/{dataset}/_index")
    return index


def co_occurrence_table(ratios: DataFrame) -> DataFrame:
    """(label_a, label_b, mean, first): mean over the distance bins and the value of the first."""
    return ratios.groupBy("label_a", "label_b").agg(F.avg("ratio").alias("mean"), F.min_by("ratio", "bin").alias("first"))
