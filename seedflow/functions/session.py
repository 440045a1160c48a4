"""Sessions, shared folders and lineage cuts for the graph operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process (tests, local runs), a folder of our own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(at)
        return at
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="seedflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that files in it can be mapped from; None if it is not on a file system."""
    shared_dir(spark)
    at = urlparse(spark.sparkContext.getCheckpointDir())
    return unquote(at.path) if at.scheme == "file" else None


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder: cuts the lineage, and columns stay prunable."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *key: str) -> tuple[DataFrame, str]:
    """The rows as a table bucketed and sorted by ``key``, and its name, to be dropped after use. Its files lie in the shared folder.

    Joins on the key shuffle the other side only, to the same number of buckets.
    """
    spark, name = df.sparkSession, f"seedflow_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *key).write.bucketBy(n, *key).sortBy(*key).format("parquet").option("path", fresh_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name), name
