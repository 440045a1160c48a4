"""Queries of operators that SQL can express, against their SQL."""

import os

import duckdb
import pytest

from seedflow import llm

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, got = llm.queries()[name](spark, DATA), con.execute(llm.oracle_sql()[name])
    order = [[d[0] for d in got.description].index(c) for c in df.columns]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(map(clean, r)) for r in df.collect()), key=key) == sorted((tuple(clean(r[i]) for i in order) for r in got.fetchall()), key=key)
