"""Readers of spatial platforms' files into ``SpatialData``, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.errors import DependencyError, MissingDataError, ParameterError
from cellweave.model import SpatialData, after_load, unique_names

POSITIONS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_row", "pxl_col")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _first(spark: SparkSession, *paths: str) -> str:
    for p in paths:
        if _exists(spark, p):
            return p
    raise MissingDataError(f"none of {', '.join(paths)} exists")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, value): lines with their number from 1. A file is one split here (wholetext), so the number is the file's order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("i", "value")).select((F.col("i") + 1).alias("i"), "value")


def matrix_market(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, var, expr) of matrix.mtx, barcodes.tsv and features.tsv or genes.tsv, plain or gzip. Entries stay lazy and splittable."""
    name = lambda *stems: _first(spark, *[f"{folder}/{s}{e}" for s in stems for e in ("", ".gz")])
    rows = spark.read.text(name("matrix.mtx")).where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    head = _first_line(rows)
    again = rows.where(F.col("value") == head).count() - 1  # an entry may read like the size line
    entries = rows.where(F.col("value") != head)
    if again:
        entries = entries.unionByName(spark.createDataFrame([(head,)] * again, "value string"))
    entries = entries.select(parts[0].cast("int").alias("g"), parts[1].cast("int").alias("c"), parts[2].cast("double").alias("value"))
    cells = _lines(spark, name("barcodes.tsv")).select(F.col("i").alias("c"), F.split("value", "\t")[0].alias("obs_id"))
    feats = _lines(spark, name("features.tsv", "genes.tsv")).select(F.col("i").alias("g"), F.coalesce(F.get(F.split("value", "\t"), F.lit(1)), F.split("value", "\t")[0]).alias("gene_id"), F.col("i").alias("ord"))
    feats = unique_names(feats)
    expr = entries.join(cells, "c").join(feats.select("g", "gene_id"), "g").where("value <> 0").select("obs_id", "gene_id", F.lit("X").alias("layer"), "value")
    return cells.select("obs_id", F.col("c").cast("long").alias("obs_ord")), feats.select("gene_id", F.col("ord").cast("long").alias("gene_ord")), expr


def _first_line(rows: DataFrame) -> str:
    first = rows.first()
    if first is None:
        raise MissingDataError("the matrix file holds no size line")
    return first[0]


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(obs_id, in_tissue, row, col, x, y) of six columns, or five without in_tissue (taken as 1); a header is told by its first word."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", ",")
    raw = raw.select(parts.alias("p")).where(~F.lower(F.col("p")[0]).isin("barcode", "barcodes"))
    six = F.size("p") >= 6
    at = lambda i: F.when(six, F.get("p", F.lit(i))).otherwise(F.get("p", F.lit(i - 1)))
    out = raw.select(F.col("p")[0].alias("obs_id"), F.when(six, F.col("p")[1].cast("int")).otherwise(1).alias("in_tissue"), at(2).cast("int").alias("row"), at(3).cast("int").alias("col"), at(5).cast("double").alias("x"), at(4).cast("double").alias("y"))
    return out.where("in_tissue = 1")


def match_barcodes(coords: DataFrame, obs: DataFrame) -> DataFrame:
    """Coordinates of known observations; barcodes that differ only in a -1 ending are matched too."""
    bare = lambda c: F.regexp_replace(c, r"-1$", "")
    exact = coords.join(obs.select("obs_id"), "obs_id", "left_semi")
    rest = coords.join(obs.select("obs_id"), "obs_id", "left_anti")
    fixed = rest.withColumn("_b", bare("obs_id")).drop("obs_id").join(obs.select("obs_id", bare("obs_id").alias("_b")), "_b").drop("_b")
    return exact.unionByName(fixed)


def scale_factors(spark: SparkSession, path: str) -> dict[str, float]:
    row = spark.read.option("multiLine", True).json(path).first()
    return {k: float(v) for k, v in row.asDict().items() if v is not None}


def visium(spark: SparkSession, path: str) -> SpatialData:
    obs, var, expr = matrix_market(spark, _first(spark, f"{path}/filtered_feature_bc_matrix", path))
    pos = _first(spark, f"{path}/spatial/tissue_positions.csv", f"{path}/spatial/tissue_positions_list.csv")
    coords = match_barcodes(positions(spark, pos), obs)
    keep = coords.select("obs_id")
    return after_load(SpatialData(obs.join(keep, "obs_id", "left_semi").join(coords.select("obs_id", "row", "col"), "obs_id"), var, expr.join(keep, "obs_id", "left_semi"), coords.select("obs_id", "x", "y")))


def xenium(spark: SparkSession, path: str) -> SpatialData:
    obs, var, expr = matrix_market(spark, _first(spark, f"{path}/cell_feature_matrix", path))
    cells = _first(spark, f"{path}/cells.parquet", f"{path}/cells.csv.gz", f"{path}/cells.csv")
    table = spark.read.parquet(cells) if cells.endswith("parquet") else spark.read.csv(cells, header=True)
    extra = [c for c in ("transcript_counts", "control_probe_counts", "control_codeword_counts", "cell_area", "nucleus_area") if c in table.columns]
    table = table.select(F.col("cell_id").cast("string").alias("obs_id"), F.col("x_centroid").cast("double").alias("x"), F.col("y_centroid").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in extra])
    obs = obs.join(table.drop("x", "y"), "obs_id")
    return after_load(SpatialData(obs, var, expr.join(obs.select("obs_id"), "obs_id", "left_semi"), table.join(obs.select("obs_id"), "obs_id", "left_semi").select("obs_id", "x", "y")))


def generic(spark: SparkSession, path: str) -> SpatialData:
    """A folder of parquet tables as ``save`` writes them: with coordinates, graphs, vectors and the log of analyses where there are any."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    named = lambda kind: {n: read(f"{kind}/{n}") for n in _folders(spark, f"{path}/{kind}")}
    log = tuple(r.asDict() for r in read("analysis_log").collect()) if _exists(spark, f"{path}/analysis_log") else ()  # a row per analysis
    return SpatialData(read("obs"), read("var"), read("expr"), read("coords") if _exists(spark, f"{path}/coords") else None, named("graphs"), named("vectors"), log)


def _folders(spark: SparkSession, path: str) -> list[str]:
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory())


def _needs_h5(spark: SparkSession, path: str) -> SpatialData:
    raise DependencyError("HDF5 and zarr files need h5py or zarr, which are not installed; convert to a folder of Matrix Market or parquet files")


PLATFORMS = {"visium": visium, "xenium": xenium, "slide_seq": generic, "merfish": generic, "seqfish": generic, "generic": generic}


def load(spark: SparkSession, path: str, platform: str = "generic") -> SpatialData:
    if platform not in PLATFORMS:
        raise ParameterError(f"unknown platform {platform}; known: {', '.join(sorted(PLATFORMS))}")
    if not _exists(spark, path):
        raise MissingDataError(f"{path} does not exist")
    return (_needs_h5 if path.rstrip("/").endswith((".h5", ".h5ad", ".zarr")) else PLATFORMS[platform])(spark, path)


def gene_sets(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(set_name, gene_id) of a GMT file: name, description, genes, tab-separated; blanks and repeats go."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) > 2).select(F.trim(parts[0]).alias("set_name"), F.explode(F.slice(parts, 3, F.size(parts))).alias("gene_id"))
    gene = F.trim("gene_id")
    return rows.select("set_name", (F.upper(gene) if upper else gene).alias("gene_id")).where("gene_id <> ''").distinct()


def ligand_receptor(spark: SparkSession, path: str) -> DataFrame:
    """(ligand, receptor) of a CSV or parquet table supplied by the user."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.csv(path, header=True)
    if not {"ligand", "receptor"} <= set(df.columns):
        raise MissingDataError("the table needs columns ligand and receptor")
    return df.select("ligand", "receptor").distinct()


def in_order(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.orderBy(column)))
