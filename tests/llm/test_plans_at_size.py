"""Joins whose sides Spark takes to be small are not sent to the driver."""

from cellweave.llm import packing, simhash


def test_probes_are_not_broadcast(spark, tmp_path):
    rows = spark.range(0, 1000).selectExpr("xxhash64(id) AS fp", "id AS rep")
    rows.write.parquet(f"{tmp_path}/classes")
    plan = simhash.links(spark.read.parquet(f"{tmp_path}/classes"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_packing_takes_the_merged_join(spark, monkeypatch):
    plans, links = [], simhash.links

    def kept(*args):
        plans.append((df := links(*args))._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "links", kept)
    docs = spark.createDataFrame([(i, f"some words of text {i}", "s") for i in range(20)], "doc_id long, text string, source string")
    assert packing.pack(docs, near=2).count() == 20
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
