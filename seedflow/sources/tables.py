"""Graphs that are derived from the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct pairs of users of consecutive events, ordered by (ts, event_id), without self pairs.

    Days are ordered on their own; the last event of a day is followed by the first of the next day.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    firsts = events.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("f"))
    bridge = firsts.select("day", F.lead("f").over(Window.orderBy("day")).alias("next_first"))
    inside = events.withColumn("nxt", F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id")))
    follow = inside.join(bridge, "day").select(F.col("user_id").alias("src"), F.coalesce("nxt", "next_first").alias("dst"))
    return follow.filter("src <> dst").distinct()


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct (customer, 2^20 + supplier) pairs through orders and lineitem."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + 1048576).cast("long").alias("dst")).distinct()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src < dst: distinct pairs of parts in one order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    other = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return lines.join(other, "l_orderkey").filter("l_partkey < dst").select(F.col("l_partkey").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
