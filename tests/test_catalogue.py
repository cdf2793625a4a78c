"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from siltstone.plans import catalogue

FOLDER = os.environ.get("SILTSTONE_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    expected = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    got, expected = tidy(got), tidy(expected)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert (got[c] - expected[c]).abs().max() < 1e-5, c
        else:
            assert got[c].astype(str).tolist() == expected[c].astype(str).tolist(), c
