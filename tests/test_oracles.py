"""Every query with an oracle gives the same rows as DuckDB on the smallest tables; the rest give rows."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry_module.queries() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.apply(lambda c: pd.to_numeric(c).astype(float) if c.dtype.kind in "iufb" else c.astype(str))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry_module.queries()[name](spark, SF).toPandas()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = plain(got), plain(want)
    assert len(got) == len(want)
    for c in got.columns:
        assert (np.isclose(got[c], want[c], rtol=0, atol=0, equal_nan=True) if got[c].dtype.kind == "f" else got[c] == want[c]).all(), c


def test_entry(spark):
    assert entry_module.entry(spark).count() == 62
