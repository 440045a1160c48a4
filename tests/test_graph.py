import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedflow.functions import bounds, rng
from seedflow.operators import weights
from seedflow.operators.graph import Graph, dense_ids
from seedflow.sources import edges, generators
from tests.conftest import LABELS


def test_coin_agrees_between_spark_numpy_and_python(spark):
    keys = [0, 1, 2, 12345, rng.MASK, rng.MASK - 1]
    h = rng.salted("edge")
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(rng.fold(h, F.col("k"))).collect()]
    assert got == [rng.fold_int(h, k) for k in keys] == rng.fold_np(np.full(len(keys), h), np.array(keys)).astype(int).tolist()


@given(st.integers(0, rng.MASK), st.integers(0, rng.MASK))
@settings(max_examples=200, deadline=None)
def test_fold_stays_in_32_bits(h, k):
    assert 0 <= rng.fold_int(h, k) <= rng.MASK
    assert rng.fold_int(h, k) == int(rng.fold_np(np.array([h]), np.array([k]))[0])


def test_club_counts_and_degrees(club):
    assert (club.n, club.m) == (34, 78)
    out = {r["orig"]: r["degree"] for r in club.degree("src").join(club.vertices, "vid").collect()}
    into = {r["orig"]: r["degree"] for r in club.degree("dst").join(club.vertices, "vid").collect()}
    assert [out[v] for v in (1, 2, 3, 24, 34)] == [16, 8, 8, 5, 0]
    assert (into[34], into[33], into[1]) == (17, 11, 0)


def test_edges_survive_both_directions(club, club_edges):
    back = club.to_original(club.to_original(club.edges.select("src", "dst"), "src"), "dst")
    assert sorted(map(tuple, back.select("src", "dst").collect())) == sorted((a, b) for a, b, _ in club_edges)
    turned = club.transpose()
    assert turned.direction == "backward"
    assert sorted(map(tuple, turned.transpose().edges.select("src", "dst").collect())) == sorted(map(tuple, club.edges.select("src", "dst").collect()))


def test_without_renumbering_there_are_phantoms(spark, club_edges):
    g = Graph.build(spark.createDataFrame(club_edges, "src long, dst long, weight double"), renumber=False)
    assert g.n == 35


def test_communities(spark, club):
    labels = spark.createDataFrame([(i + 1, int(c)) for i, c in enumerate(LABELS.split())], "orig long, community long")
    inside = club.communities(labels)
    sizes = {r[0]: (r[1] + 1, r[2]) for r in inside.groupBy("community").agg(F.max(F.greatest("src", "dst")), F.count("*")).collect()}
    assert sizes == {0: (12, 24), 1: (5, 6), 2: (11, 20), 3: (6, 7)}


def test_unknown_ids_raise(spark, club):
    with pytest.raises(ValueError):
        club.dense_list([1, 999])
    with pytest.raises(ValueError):
        club.original_list([-1])
    with pytest.raises(ValueError):
        club.to_dense(spark.createDataFrame([(77,)], "orig long"))
    assert club.original_list(club.dense_list([34, 1])) == [34, 1]


def test_multigraph_keeps_parallel_edges_and_loops(spark):
    g = Graph.build(spark.createDataFrame([(5, 5, 0.1), (5, 9, 0.2), (5, 9, 0.2), (9, 5, 1.0)], "src long, dst long, weight double"))
    assert (g.n, g.m) == (2, 4)
    assert len({r[0] for r in g.edges.select("eh").collect()}) == 4


def test_empty_graph(spark):
    g = Graph.build(spark.createDataFrame([], "src long, dst long, weight double"))
    assert (g.n, g.m) == (0, 0)


def test_dense_ids_rank_values(spark):
    got = dense_ids(spark.createDataFrame([(x,) for x in (7, -3, 7, 100, 2**40)], "x long"), "x").orderBy("vid").collect()
    assert [tuple(r) for r in got] == [(-3, 0), (7, 1), (100, 2), (2**40, 3)]


def test_weights(club):
    wc = {tuple(r) for r in weights.weighted_cascade(club.edges).groupBy("dst").agg(F.round(F.sum("weight"), 9)).select(F.col("round(sum(weight), 9)")).collect()}
    assert wc == {(1.0,)}
    u = [r[0] for r in weights.uniform(club.edges).select("weight").collect()]
    assert all(0 <= x < 1 for x in u) and 0.35 < sum(u) / len(u) < 0.65
    n = [r[0] for r in weights.truncated_normal(club.edges, 0.5, 0.1).select("weight").collect()]
    assert all(0 <= x <= 1 for x in n) and abs(sum(n) / len(n) - 0.5) < 0.05
    lt = weights.lt_normalize(weights.uniform(club.edges)).groupBy("dst").agg(F.sum("weight").alias("t")).agg(F.max("t")).first()[0]
    assert lt <= 1
    assert weights.quantize(weights.constant(club.edges, 1.0), 16).agg(F.max("wq")).first()[0] == 65535
    with pytest.raises(ValueError):
        weights.assign(club.edges, "poisson")


def test_parse_lines(spark, tmp_path):
    (tmp_path / "g.txt").write_text("% head\n\n1 2 0.5 extra\n# x\n3\t4\t0.25\n  5   6  1\n1 2 # no\n")
    got = edges.read_edges(spark, str(tmp_path / "g.txt"), weighted=True, scale=0.5).orderBy("src").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.25), (3, 4, 0.125), (5, 6, 0.5)]
    both = edges.read_edges(spark, str(tmp_path / "g.txt"), weighted=True, undirected=True)
    assert both.count() == 6 and {tuple(r) for r in both.collect()} >= {(2, 1, 0.5), (6, 5, 1.0)}
    with pytest.raises(ValueError):
        edges.read_edges(spark, str(tmp_path / "g.txt"), weighted=True, scale=1.5)
    with pytest.raises(ValueError):
        edges.load_graph(spark, str(tmp_path / "g.txt"), model="XX")
    with pytest.raises(ValueError):
        edges.load_graph(spark, str(tmp_path / "g.txt"), distribution="poisson")


def test_undirected_unweighted_edges_draw_two_weights(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1 2\n2 3\n")
    g = edges.load_graph(spark, str(tmp_path / "g.txt"), undirected=True)
    w = {(r["src"], r["dst"]): r["weight"] for r in g.edges.collect()}
    assert len(w) == 4 and w[0, 1] != w[1, 0]


def test_store_and_reload(spark, club, tmp_path):
    path = str(tmp_path / "stored")
    edges.write_graph(club, path)
    again = edges.reload_graph(spark, path, "forward")
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, club.edges.collect()))
    with pytest.raises(ValueError):
        edges.reload_graph(spark, path, "backward")
    assert edges.reload_graph(spark, path, scale=0.5).edges.agg(F.max("weight")).first()[0] == 0.25
    assert edges.open_or_create(spark, path, None).n == 34
    edges.write_edge_text(club, str(tmp_path / "text"), normalize=True)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert len(lines) == 78 and "1 2 0.5" in lines


def test_communities_file(spark, tmp_path):
    (tmp_path / "c.txt").write_text("0 0\n1\t2\n")
    assert [tuple(r) for r in edges.read_communities(spark, str(tmp_path / "c.txt")).orderBy("orig").collect()] == [(1, 0), (2, 0), (3, 1), (4, 2)]


def test_generators(spark):
    r = generators.rmat(spark, 6)
    assert r.count() == 16 * 64 and r.agg(F.max(F.greatest("src", "dst"))).first()[0] < 64
    skew = r.groupBy("src").count().agg(F.max("count")).first()[0]
    assert skew > 32
    assert generators.watts_strogatz(spark, 100).filter("src = dst").count() == 0
    b = generators.barabasi_albert(spark, 200)
    assert b.filter("dst > src").count() == 0 and b.groupBy("dst").count().agg(F.max("count")).first()[0] > 40
    p = generators.planted(spark, 160, mixing=0.1)
    assert p.filter("floor(src / 10) = floor(dst / 10)").count() > 0.85 * p.count()
    f = generators.lfr(spark, 600, mixing=0.0)
    assert {r[1] for r in f.groupBy("src").count().collect()} <= {5, 6} and f.filter("abs(src - dst) > 6 OR dst < 0 OR dst >= 600").count() == 0
    wide = generators.lfr(spark, 2000, degrees=(2, 40), sizes=(10, 200))
    d = wide.groupBy("src").count().agg(F.min("count"), F.max("count"), F.avg("count")).first()
    assert d[0] == 2 and d[1] > 15 and d[2] < 10


def test_bounds():
    assert math.isclose(bounds.log_binomial(10, 3), math.log(120))
    assert bounds.imm_theta(0.5, 1, 10, 0, 100) == 0
    first, most = bounds.opim_limits(0.5, 0.05, 10, 1500)
    assert 0 < first < most
    assert bounds.opim_lower(100, 1000, 500, 0.01) < 50 < bounds.opim_upper(100, 1000, 500, 0.01)
    t = bounds.imm_theta_prime(4, 0.7, 1, 5, 1000)
    assert abs(bounds.imm_inverse_theta_prime(t, 0.7, 1, 5, 1000) - 4) < 1e-3
