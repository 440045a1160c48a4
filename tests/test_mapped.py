"""Adjacency arrays that tasks map from the shared folder, and what rests on them."""

import os

import duckdb
import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from seedflow.operators.graph import Graph, MappedCsr
from seedflow.operators.sampling import _joined, _walked, rrr_sets, samples
from seedflow.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def _random(spark, n=60, m=240, weight=None):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.random(m), strict=True)]
    return Graph.build(spark.createDataFrame([(a, b, weight or w) for a, b, w in rows], "src long, dst long, weight double"), renumber=False)


def _jobs(spark, run):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        got = run()
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("by", ["src", "dst"])
def test_mapped_arrays_equal_those_of_the_driver(spark, by):
    gaps = [(9, 3, 0.5), (9, 3, 0.25), (2, 9, 1.0), (9, 9, 0.0)]  # vertices without edges, parallel edges, a loop
    for g in (_random(spark), Graph.build(spark.createDataFrame(gaps, "src long, dst long, weight double"), renumber=False), Graph.build(spark.createDataFrame([], "src long, dst long"), renumber=False)):
        sent, want = g.sent_csr(by), g.csr(by)
        assert isinstance(sent, MappedCsr)
        got = sent.value
        for c in ("indptr", "to", "thr", "eh"):
            assert (getattr(got, c) == getattr(want, c)).all(), c
        assert (got.running() == want.running()).all()


@pytest.mark.parametrize("model", ["LT", "LTR", "IC"])
def test_deep_sets_take_few_jobs(spark, model):
    """The frontier strategy's number of jobs does not grow with the depth of sets (before: several for each of 300 hops)."""
    g = Graph.build(spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long"))
    got, jobs = _jobs(spark, lambda: rrr_sets(g, 8, model, strategy="frontier").groupBy("sid").count().collect())
    local = {r["sid"]: r["count"] for r in rrr_sets(g, 8, model, strategy="local").groupBy("sid").count().collect()}
    assert {r["sid"]: r["count"] for r in got} == local and len(local) == 8 and max(local.values()) > 100
    assert jobs < 40


@pytest.mark.parametrize("model,forward", [("IC", False), ("LT", True), ("LTR", False)])
def test_walks_equal_joins(spark, model, forward):
    """Several starts a sample, and vertices that count as reached before."""
    g = _random(spark, weight=0.1)
    starts = samples(spark, 0, 12).withColumn("v", F.explode(F.array(F.col("sid") * 3, F.lit(7).cast("long"))))
    seen = spark.createDataFrame([(s, v) for s in range(14) for v in (s, 20, 21)], "sid long, v long")
    a, b = (sorted(map(tuple, f(g, starts, model, forward, seen).select("sid", "v", "hop").collect())) for f in (_walked, _joined))
    assert a == b and len(a) > 12



def test_deep_sets_in_words_take_few_jobs(spark):
    """So do those of the blocks, whose hops read all blocks; words of one task hold up to 64 samples."""
    g = Graph.build(spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long"))
    got, jobs = _jobs(spark, lambda: rrr_sets(g, 8, strategy="blocks").groupBy("sid").count().collect())
    assert {r["sid"]: r["count"] for r in got} == {r["sid"]: r["count"] for r in rrr_sets(g, 8, strategy="local").groupBy("sid").count().collect()}
    assert max(r["count"] for r in got) > 100 and jobs < 40
    for g in (_random(spark), _random(spark, 40, 400, 0.2)):
        a, b = (sorted(map(tuple, rrr_sets(g, 700, strategy=s, start=30).collect())) for s in ("blocks", "local"))
        assert a == b and len(a) > 700


def test_no_adjacency_passes_the_driver(spark, monkeypatch):
    """Before, every graph query brought the adjacency arrays to the driver and sent them out as a broadcast variable."""
    from seedflow.operators import influence

    def refused(*_):
        raise AssertionError("the adjacency was brought to the driver")

    monkeypatch.setattr(Graph, "csr", refused)
    g = _random(spark, 30, 90, 0.4)
    assert len(influence.hill_climb(g, 2, 4, model="LT").seeds) == 2 and len(influence.hill_climb(g, 2, 4).seeds) == 2
    for model, strategy in (("IC", "auto"), ("IC", "bits"), ("IC", "local"), ("IC", "blocks"), ("IC", "frontier"), ("LT", "auto"), ("LTR", "auto")):
        assert rrr_sets(g, 9, model, strategy=strategy).select("sid").distinct().count() == 9
    assert len(influence.imm(g, 2, 0.5, "LT", max_sets=200).seeds) == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["rrr_coverage_ic", "rrr_members_ic", "rrr_sizes_half", "seed_coverage", "rrr_store_resume", "kpt_mean", "rrr_width", "coverage_update", "rrr_race_local"])
def test_queries_bring_few_rows_to_the_driver(spark, monkeypatch, name):
    """Before, each of them brought all edges of the graph to the driver; now sizes of partitions and sums alone, and the results equal the SQL."""
    frame, brought = type(spark.range(1)), []

    def collect(df):
        brought.append(own(df))
        return brought[-1]

    def refused(*_):
        raise AssertionError("rows or variables pass the driver whole")

    own = frame.collect
    with monkeypatch.context() as m:
        m.setattr(frame, "collect", collect)
        m.setattr(frame, "toArrow", refused)
        m.setattr(SparkContext, "broadcast", refused)
        df = QUERIES[name](spark, DATA)
    assert sum(map(len, brought)) <= 64
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.execute(ORACLES[name])
    order = [[d[0] for d in want.description].index(c) for c in df.columns]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(map(clean, r)) for r in df.collect()) == sorted(tuple(clean(r[i]) for i in order) for r in want.fetchall())
