"""Every registered query against its SQL on the smallest data set."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
from tallmat.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["row_id", "comp", "val"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = driver.queries()[name](spark, DATA).toPandas()
    want = duck.execute(driver.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want) > 0
    got = got[columns].sort_values(columns, ignore_index=True)
    want = want[columns].sort_values(columns, ignore_index=True)
    for c in columns:
        assert got[c].dtype == want[c].dtype, c
        if want[c].dtype == np.float64:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=2e-6, err_msg=c)
        else:
            assert (got[c] == want[c]).all(), c
