"""Every registered query of the event engine against its SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from eventloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype(str)
        elif pd.api.types.is_numeric_dtype(out[c]):
            out[c] = out[c].astype(float).round(6).astype(str)
        else:
            out[c] = out[c].map(lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else str(x))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def test_each_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, base, name):
    got, want = canonical(catalog.QUERIES[name](spark, SF).toPandas()), canonical(base.execute(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)
    assert len(got)
