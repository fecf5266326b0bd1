"""Every query with a SQL twin must equal it on the smallest tables, whatever the order of rows."""

from __future__ import annotations

import glob
import math

import numpy as np
import pytest

from lanternq import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def views(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {f.rsplit('/', 1)[1][:-8]} as select * from '{f}'")
    return c


def canon(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return ""
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
            return repr(round(float(v), 9) + 0.0)
        return str(list(v)) if hasattr(v, "tolist") and not np.isscalar(v) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_twin(spark, data, views, name):
    got = catalog.queries()[name](spark, data).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = views.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
