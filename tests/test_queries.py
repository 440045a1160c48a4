"""Every registered graph query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from seedflow.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["rrr_coverage_ic", "rrr_sizes_lt", "rrr_frontier_ic", "sim_ic", "hc_k2", "hc_lt_k2", "sim_lt", "rrr_store_resume", "rrr_sizes_ic_u8", "partition_sets", "lt_normalize", "parse_edge_lines", "community_sizes", "max_coverage_distributed", "max_coverage_handover", "rrr_bits_ic", "rrr_race_local", "rrr_blocks_ic", "imm", "opimc", "tim", "community_greedy_best", "community_list", "binary_graph", "sample_bounds"])
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = con.execute(ORACLES[name])
    order = [[d[0] for d in got.description].index(c) for c in df.columns]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(map(clean, r)) for r in df.collect()) == sorted(tuple(clean(r[i]) for i in order) for r in got.fetchall())


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_edge_stream(spark, tmp_path):
    from seedflow.streaming import edge_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    q = edge_stream.follow_edges(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in edge_stream.degrees(spark, str(tmp_path / "out")).collect()] == [(2, 2)]
