"""Passes of bits over live edges, for many starts at a time."""

import numpy as np
import pytest


@pytest.mark.parametrize("n,m", [(1, 0), (40, 0), (300, 280), (300, 900)])
def test_passes_count_what_each_start_adds(n, m):
    from seedflow.operators.sampling import beyond, by_tail, sweep

    rng = np.random.default_rng(7)
    tail, head = rng.integers(0, n, m), np.sort(rng.integers(0, n, m))
    seen = sweep(n, tail, head, np.array([0])) > 0  # what a seed reaches
    starts = rng.permutation(n)
    got = beyond(*by_tail(n, tail, head), starts, seen)
    for a in range(0, n, 64):
        mask = sweep(n, tail, head, starts[a : a + 64])[~seen]
        assert [int((mask >> np.uint64(k) & np.uint64(1)).sum()) for k in range(len(starts[a : a + 64]))] == got[a : a + 64].tolist()


def test_gains_of_all_are_dealt_out_in_pieces(spark, monkeypatch):
    """Any size of pieces gives the same gains (before: one task a world went through all candidates)."""
    from pyspark.sql import functions as F

    from seedflow.operators import influence, weights
    from seedflow.operators.graph import Graph

    g = Graph.build(spark.createDataFrame([(i, j) for i in range(60) for j in (i * 7 % 60, i * 11 % 60, (i + 1) % 60)], "src long, dst long"), weigh=weights.weighted_cascade)
    monkeypatch.setattr(influence, "PIECE", 8)
    spread = influence.Spread(g, 2)
    gains = spread.gains(g.vertices.select(F.col("vid").alias("v")))
    parted = dict(map(tuple, gains.select("v", "gain").collect()))
    monkeypatch.setattr(influence, "PIECE", 1 << 20)
    whole = dict(map(tuple, spread.gains(g.vertices.select(F.col("vid").alias("v"))).select("v", "gain").collect()))
    assert parted == whole and len(parted) == g.n
