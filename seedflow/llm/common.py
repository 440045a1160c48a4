"""Shared pieces of the training-data operators: inputs, shared folders, byte-level words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import checkpoint, fresh_path, shared_dir  # noqa: F401
from ..shipping import ship

#: ASCII white space, as a Java / RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read again: cuts the lineage, keeps columns prunable."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once even if body refers to it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_key(source: Column) -> Column:
    """A non-null key that keeps null apart from every string."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


#: A table of up to this many rows is sent to every executor.
BROADCAST_ROWS = 100_000
#: A key of more than this many rows, and of more than this share of all rows, is dealt out over ``SALTS`` tasks.
HOT_ROWS, HOT_SHARE, SALTS = 1000, 1000, 64


def join_hot(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, how: str = "inner", broadcast: int = BROADCAST_ROWS, hot: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has each key once; both are cheap to read again. Any share of ``left`` may have one key.

    A small ``right`` of narrow rows is broadcast (``broadcast`` 0: never). Else keys are salted that occur
    in ``left`` more than ``hot`` times and more often than one row in ``HOT_SHARE``, of which there are at
    most ``HOT_SHARE``; the rows of ``right`` that they need are copied ``SALTS`` times. ``counted``: rows with the keys
    of ``left`` that are cheaper to count.
    """
    right = right.withColumnRenamed(right_key or key, key)
    if broadcast and right.limit(broadcast + 1).count() <= broadcast:
        return left.join(F.broadcast(right), key, how)
    counted = left if counted is None else counted
    least = max(hot, counted.count() // HOT_SHARE)
    often = [r[0] for r in counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key).collect()]
    if not often:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(often)
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c != key]), F.lit(SALTS)).cast("int")).otherwise(0))
    copied = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
