"""Every registered query with SQL beside it, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from oplogue.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(str).replace(["nan", "NaT", "<NA>", "None"], "-")
    return sorted(map(tuple, df.values.tolist())), list(df.columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(registry.ORACLES[name]).df())
