"""Edges that arrive as a stream: kept as a table, with degrees refreshed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow_edges(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append src, dst[, weight] of every batch to ``path/edges`` and its in-degrees to ``path/degrees``.

    A batch writes below its own number, so a batch that runs again replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.withColumn("batch", F.lit(number))
        df.write.mode("overwrite").parquet(f"{path}/edges/batch={number:09d}")
        df.groupBy("dst").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/degrees/batch={number:09d}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def degrees(spark, path: str) -> DataFrame:
    """dst, degree over all batches so far."""
    return spark.read.parquet(f"{path}/degrees").groupBy("dst").agg(F.sum("n").alias("degree"))


def active_users(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and distinct users (approximate) of tumbling windows of an event stream, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))
