"""Synthetic graphs from counter-based coins: R-MAT, Watts-Strogatz, Barabasi-Albert by copying, planted communities, power-law communities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import ONE, fold, fold_int


def _coin(purpose: int, *keys: Column) -> Column:
    h: Column | int = fold_int(77, purpose)
    for k in keys:
        h = fold(h, k)
    return h / float(ONE)


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 0) -> DataFrame:
    """src, dst of 2^scale vertices and edge_factor * 2^scale edges: every level of an edge picks a quadrant."""

    def level(acc: Column, i: Column) -> Column:
        return F.struct((acc["s"] * 2 + (acc["u"] >= a + b).cast("long")).alias("s"), (acc["d"] * 2 + (((acc["u"] >= a) & (acc["u"] < a + b)) | (acc["u"] >= a + b + c)).cast("long")).alias("d"), _coin(seed * 64 + 1, F.col("id"), i).alias("u"))

    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("d"), _coin(seed * 64 + 1, F.col("id"), F.lit(0)).alias("u"))
    drawn = spark.range(edge_factor << scale).withColumn("e", F.aggregate(F.sequence(F.lit(1), F.lit(scale)), start, level))
    return drawn.select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"))


def watts_strogatz(spark: SparkSession, n: int, neighbors: int = 8, p: float = 0.5, seed: int = 0) -> DataFrame:
    """A ring with ``neighbors`` on each side; each edge's end is rewired with probability p."""
    ring = spark.range(n).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(neighbors))))
    near = (F.col("id") + F.col("j")) % n
    far = (F.col("id") + 1 + F.floor(_coin(seed * 64 + 3, F.col("id"), F.col("j")) * (n - 1))) % n
    return ring.select(F.col("id").alias("src"), F.when(_coin(seed * 64 + 2, F.col("id"), F.col("j")) < p, far).otherwise(near).cast("long").alias("dst"))


def barabasi_albert(spark: SparkSession, n: int, each: int = 8, seed: int = 0) -> DataFrame:
    """Preferential attachment by copying: slot t picks an earlier slot and takes its source or, following the copy, its target.

    A copied target is resolved by following its own coin, at most 64 steps, all in one expression.
    """

    def step(acc: Column, _: Column) -> Column:
        pick = F.floor(_coin(seed * 64 + 4, acc["t"]) * acc["t"] * 2).cast("long")  # an end of an earlier edge
        done = acc["done"] | (acc["t"] <= 0)
        tail = (pick % 2) == 0
        return F.struct(
            F.when(done, acc["v"]).otherwise(F.floor(F.floor(pick / 2) / each)).cast("long").alias("v"),
            F.when(done, acc["t"]).otherwise(F.floor(pick / 2)).cast("long").alias("t"),
            (done | tail).alias("done"),
        )

    start = F.struct(F.lit(0).cast("long").alias("v"), F.col("id").alias("t"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)
    return spark.range(n * each).select(F.floor(F.col("id") / each).cast("long").alias("src"), end["v"].alias("dst"))


def planted(spark: SparkSession, n: int, degree: int = 6, communities: int = 16, mixing: float = 0.5, seed: int = 0) -> DataFrame:
    """Communities of equal size; an edge leaves its community with probability ``mixing``."""
    size = max(n // communities, 1)
    drawn = spark.range(n).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(degree))))
    own = F.floor(F.col("id") / size) * size + F.floor(_coin(seed * 64 + 6, F.col("id"), F.col("j")) * size)
    far = F.floor(_coin(seed * 64 + 7, F.col("id"), F.col("j")) * n)
    dst = F.when(_coin(seed * 64 + 5, F.col("id"), F.col("j")) < mixing, far).otherwise(F.least(own, F.lit(n - 1)))
    return drawn.select(F.col("id").alias("src"), dst.cast("long").alias("dst"))


def lfr(spark: SparkSession, n: int, degrees: tuple[int, int] = (5, 6), sizes: tuple[int, int] = (5, 6), mixing: float = 0.5, seed: int = 0) -> DataFrame:
    """src, dst with degrees of a power law (exponent 2) and communities whose sizes follow one of exponent 1.

    Communities are ranges of ids in falling size. With exponent 1 the logarithm of a size is uniform, so
    the community of an id and the ends of its range have closed forms, and nothing is looked up.
    """
    (low, high), (small, large) = degrees, sizes
    spread = math.log(large / small)
    count = max(round(n * spread / (large - small)), 1) if large > small else max(n // small, 1)

    def first(j: Column) -> Column:
        """The first id of community j."""
        if large == small:
            return F.floor(j * n / count)
        return F.ceil((large - small * F.exp((1 - j / count) * spread)) / (large - small) * n - 1e-6)

    v = F.col("id")
    size = large - v / n * (large - small)
    own = F.least(F.floor((1 - F.log(size / small) / spread) * count + 1e-9) if large > small else F.floor(v * count / n), F.lit(count - 1))
    degree = F.floor(1 / (1 / low - _coin(seed * 64 + 8, v) * (1 / low - 1 / high)) + 0.5).cast("int")
    drawn = spark.range(n).withColumn("_c", own).withColumn("j", F.explode(F.sequence(F.lit(1), degree)))
    a, b = first(F.col("_c")), first(F.col("_c") + 1)
    inside = a + F.floor(_coin(seed * 64 + 9, v, F.col("j")) * F.greatest(b - a, F.lit(1)))
    outside = F.floor(_coin(seed * 64 + 10, v, F.col("j")) * n)
    dst = F.when(_coin(seed * 64 + 11, v, F.col("j")) < mixing, outside).otherwise(F.least(inside, F.lit(n - 1)))
    return drawn.select(v.alias("src"), dst.cast("long").alias("dst"))
