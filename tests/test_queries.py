"""Every registered query of the library's own operators against its SQL, as the driver compares them."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from rasterloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(str(tuple(clean(v) for v in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = sql.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    same = lambda df: [x.replace(".0,", ",").replace(".0)", ")") for x in rows(df)]
    assert same(got) == same(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
