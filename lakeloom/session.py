"""The session factory."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike; sizes come from the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app: str = "lakeloom", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one. A cluster's own settings win; without one, ``local[*]``."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    if master or not os.environ.get("SPARK_MASTER_URL"):
        cores = os.cpu_count() or 4
        builder = builder.master(master or "local[*]").config("spark.ui.enabled", "false")
        if "spark.sql.shuffle.partitions" not in conf:
            builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once, as Spark sends any Python file: functions travel by name."""
    context = spark.sparkContext
    if not getattr(context, "_lakeloom_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="lakeloom-")  # the driver serves the file from here as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/lakeloom", "zip", os.path.dirname(root), os.path.basename(root)))
        context._lakeloom_shipped = True
