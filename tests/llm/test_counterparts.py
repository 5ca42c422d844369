"""Queries with a DuckDB counterpart give the same rows."""

import os

import duckdb
import pandas as pd
import pytest

from proselens.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want, got = c.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda df: sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(got) == rows(want) and len(got)
