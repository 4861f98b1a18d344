"""Ranks over all rows and corrections of many p-values."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from cellweave import registry
from cellweave.functions import stats


def test_overall_rank(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1.5, 2.5, -1.0, 7.0, rng.random()]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(5)
    got = {r["i"]: r["rank"] for r in stats.overall_rank(df, "v", "rank").collect()}
    ordered = sorted(values, key=lambda v: (v is None, -(v or 0)))
    assert all(got[i] == (ordered.index(v) + 1 + len(ordered) - ordered[::-1].index(v)) / 2 for i, v in enumerate(values))
    assert stats.overall_rank(df.where("false"), "v", "rank").count() == 0


def test_corrections_are_linear(spark):
    p = np.random.default_rng(0).random(200_000)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"i": np.arange(len(p)), "p": p}))
    began = time.time()
    got = stats.adjust(df, order=("i",)).agg(F.sum("q"), F.min("q")).first()
    assert time.time() - began < 30
    order = np.sort(p) * len(p) / np.arange(1, len(p) + 1)
    want = np.minimum(1, np.minimum.accumulate(order[::-1])[::-1])
    np.testing.assert_allclose([got[0], got[1]], [want.sum(), want.min()], rtol=1e-9)


def test_methods_by_name():
    for family, names in {"communities": ["label_propagation", "leiden"], "graphs": ["delaunay", "grid", "knn", "radius"], "registration": ["paste", "similarity", "stalign", "transport"]}.items():
        assert registry.methods(family) == names
