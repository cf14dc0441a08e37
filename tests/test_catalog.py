"""Every query of the catalog against its SQL, on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from quarrymill.plans import audits, coverages, drafts, evaluation, integrity, records, retrieval, stances, stores, texts  # noqa: F401
from quarrymill.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    one = lambda v: None if pd.isna(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted((tuple(one(v) for v in row) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() & ORACLES.keys()))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
