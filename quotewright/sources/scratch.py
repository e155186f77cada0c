"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """``folder``, or the one the cluster names in ``spark.checkpoint.dir``.

    Only a session with a local master may go without either; it uses its warehouse.
    """
    folder = folder or spark.conf.get(SETTING, None)
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = spark.conf.get(WAREHOUSE)
    if not folder:
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return f"{folder.rstrip('/')}/quotewright"


def fresh_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in the shared folder; every call gives another one."""
    return f"{shared_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession, folder: str | None = None) -> bool:
    """Delete everything this library wrote to the shared folder.

    Call it when no result that reads an intermediate table is needed any more.
    Returns whether there was anything.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark, folder))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
