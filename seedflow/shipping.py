"""Makes the package importable in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of an Arrow batch; Spark's own default holds ten thousand texts of any length outside the heap of an executor.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context; Spark's file server distributes the archive.

    Arrow batches are made small as well, unless the session sets their size itself.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_seedflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    work = tempfile.mkdtemp(prefix="seedflow-src-")
    atexit.register(shutil.rmtree, work, ignore_errors=True)
    shutil.copytree(package, f"{work}/src/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{work}/{package.name}", "zip", f"{work}/src"))
    sc._seedflow_shipped = True
