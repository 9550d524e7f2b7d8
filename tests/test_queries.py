"""Every registered query against its SQL on the smallest data."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from symgrove.plans import catalogue

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(df):
    def cell(x):
        if pd.isna(x):
            return "NULL"
        return f"{float(x):.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    want = duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) == set(catalogue.ORACLE)
