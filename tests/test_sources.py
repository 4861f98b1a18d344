import gzip

import pytest
from pyspark.sql import functions as F

from cellweave import errors
from cellweave.sources import readers, sinks
from cellweave.streaming.incremental_qc import running_qc, windowed_qc


@pytest.fixture
def visium(tmp_path):
    m = tmp_path / "filtered_feature_bc_matrix"
    m.mkdir()
    (tmp_path / "spatial").mkdir()
    with gzip.open(m / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n3 2 4\n1 1 5\n2 1 1\n3 2 2\n1 2 0\n")
    (m / "barcodes.tsv").write_text("AAA-1\nBBB-1\n")
    (m / "features.tsv").write_text("id1\tGeneA\nid2\tGeneA\nid3\tMT-X\n")
    (tmp_path / "spatial/tissue_positions_list.csv").write_text("AAA,1,0,0,10,20\nBBB-1,1,0,2,11,21\nCCC-1,0,0,4,1,1\n")
    (tmp_path / "spatial/scalefactors_json.json").write_text('{"spot_diameter_fullres": 2.5, "tissue_hires_scalef": 0.1}')
    return tmp_path


def test_visium_round_trip(spark, visium, tmp_path):
    data = readers.load(spark, str(visium), "visium")
    assert {(r[0], r[1], r[2]) for r in data.layer("counts").collect()} == {("AAA-1", "GeneA", 5.0), ("AAA-1", "GeneA-1", 1.0), ("BBB-1", "MT-X", 2.0)}
    assert {(r["obs_id"], r["x"], r["y"]) for r in data.coords.collect()} == {("AAA-1", 20.0, 10.0), ("BBB-1", 21.0, 11.0)}
    assert readers.scale_factors(spark, f"{visium}/spatial/scalefactors_json.json")["spot_diameter_fullres"] == 2.5
    sinks.save(data.logged("load", "visium", {"path": "x"}), f"{tmp_path}/out")
    again = readers.load(spark, f"{tmp_path}/out")
    assert again.layer("raw").count() == 3


def test_gmt(spark, tmp_path):
    (tmp_path / "sets.gmt").write_text("S1\tabout\tA\tB\t\tA\nS2\tabout\tC\nshort\n")
    assert {tuple(r) for r in readers.gene_sets(spark, f"{tmp_path}/sets.gmt").collect()} == {("S1", "A"), ("S1", "B"), ("S2", "C")}


def test_missing_and_unknown(spark, tmp_path):
    with pytest.raises(errors.MissingDataError):
        readers.load(spark, f"{tmp_path}/nothing")
    with pytest.raises(errors.ParameterError):
        readers.load(spark, str(tmp_path), "vhs")


def test_export(spark, tmp_path, visium):
    data = readers.load(spark, str(visium), "visium")
    index = sinks.export_results(data, {"cells": data.obs}, f"{tmp_path}/results", "d1", "qc", "basic")
    assert spark.read.csv(index.first()["path"], header=True).count() == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 10, 2.0), (1, 11, 0.0), (2, 10, 1.0)], "obs_id long, gene_id long, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("obs_id long, gene_id long, value double").parquet(f"{tmp_path}/in")
    q = running_qc(stream).writeStream.outputMode("complete").format("memory").queryName("qc").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("qc").collect()} == {(1, 1, 2.0), (2, 1, 1.0)}
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "ts string, key string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert windowed_qc(e).first()["total"] == 3.0
