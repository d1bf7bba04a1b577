"""Every query outside llm against its SQL on the smallest data set, where that is present."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallgrass.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def canon(df):
    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_no_harm(spark):
    rows = catalog.QUERIES["repair_no_harm"](spark, DATA).collect()
    assert all(r.broken == 0 for r in rows)


def test_no_cross_joins_of_tables():
    import tallgrass.plans.base as base

    assert "crossJoin" not in open(base.__file__, encoding="utf-8").read()
