"""Edge weights: constant, uniform, truncated normal, weighted cascade, linear-threshold normalisation, quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import ONE, fold, salted
from .graph import threshold


def _weighted(edges: DataFrame, weight: Column) -> DataFrame:
    return edges.withColumn("weight", weight).withColumn("thr", threshold(F.col("weight")))


def edge_coin(purpose: str = "weight", seed: int = 0) -> Column:
    """A 32-bit coin of an edge for one purpose."""
    return fold(F.col("eh"), F.lit(salted(purpose, seed)))


def constant(edges: DataFrame, mean: float = 0.5) -> DataFrame:
    if not 0 <= mean <= 1:
        raise ValueError("a constant weight lies between 0 and 1")
    return _weighted(edges, F.lit(float(mean)))


def uniform(edges: DataFrame, scale: float = 1.0, seed: int = 0) -> DataFrame:
    return _weighted(edges.withColumn("_u", edge_coin(seed=seed)), F.col("_u") / float(ONE) * float(scale)).drop("_u")


def truncated_normal(edges: DataFrame, mean: float = 0.5, deviation: float = 1.0, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Normal weights conditioned on [0, 1], by inversion; the inverse error function is the closed-form approximation by Winitzki (error 2e-3)."""
    cdf = lambda x: 0.5 * (1 + math.erf((x - mean) / (deviation * math.sqrt(2))))
    low, high = cdf(0.0), cdf(1.0)
    x = (F.col("_u") + 0.5) / float(ONE) * (2 * (high - low)) + (2 * low - 1)
    a = 0.147
    two = edges.withColumn("_u", edge_coin(seed=seed)).withColumn("_x", x).withColumn("_l", F.log(1 - F.col("_x") * F.col("_x")))
    b = F.lit(2 / (math.pi * a)) + F.col("_l") / 2
    inverse = F.signum("_x") * F.sqrt(F.sqrt(b * b - F.col("_l") / a) - b)
    return _weighted(two, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + deviation * math.sqrt(2) * inverse)) * float(scale)).drop("_u", "_x", "_l")


def weighted_cascade(edges: DataFrame) -> DataFrame:
    """1 / in-degree of the head; thr in integers."""
    indegree = edges.groupBy("dst").agg(F.count("*").alias("_d"))
    return edges.join(indegree, "dst").withColumn("weight", 1 / F.col("_d")).withColumn("thr", F.expr(f"{ONE} DIV _d")).drop("_d").select(*edges.columns)


def lt_normalize(edges: DataFrame, by: str = "dst", seed: int = 0) -> DataFrame:
    """Divide by the sum of the weights at ``by`` plus a draw for "none of them"; by="src" is the compatible form.

    The sum is of integers (``thr``), so it does not depend on the order of the edges; it is an
    aggregation joined back, so a hub's edges are not gathered in one task.
    """
    total = edges.groupBy(by).agg(F.sum("thr").alias("_sum")).withColumn("_total", (F.col("_sum") + fold(F.lit(salted("rest", seed)), F.col(by))) / float(ONE))
    return _weighted(edges.join(total.drop("_sum"), by), F.col("weight") / F.col("_total")).select(*edges.columns)


def quantize(edges: DataFrame, bits: int = 8) -> DataFrame:
    """Weights as integers of 8 or 16 bits, column ``wq``; an edge is then live when the first bits of its coin are at most ``wq``."""
    return edges.withColumn("wq", quantum(F.col("weight"), bits)).withColumn("thr", quantum_threshold(F.col("wq"), bits))


def quantum(weight: Column, bits: int) -> Column:
    if bits not in (8, 16):
        raise ValueError("8 or 16 bits")
    return F.floor(weight * float((1 << bits) - 1)).cast("int")


def quantum_threshold(wq: Column, bits: int) -> Column:
    return (wq.cast("long") + 1) * F.lit(1 << (32 - bits))


def undirected(edges: DataFrame, shared: bool = True) -> DataFrame:
    """Both directions of src, dst[, weight]; ``shared`` False leaves the reverse weight null, to be drawn on its own."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[(F.col(c) if shared else F.lit(None).cast("double")).alias(c) for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back.select(*edges.columns))


ASSIGN = {"uniform": uniform, "normal": truncated_normal, "const": constant}


def assign(edges: DataFrame, distribution: str, **how) -> DataFrame:
    if distribution not in ASSIGN:
        raise ValueError(f"unsupported distribution: {distribution}")
    return ASSIGN[distribution](edges, **how)
