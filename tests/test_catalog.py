"""Every query of the library against DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from wavequarry.plans import catalog, catalog_live, catalog_more, catalog_sql, catalog_zoom  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=True)
