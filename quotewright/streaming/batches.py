"""Tables that a streaming job keeps: a folder per batch, so a batch that runs again replaces what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


def start(spark: SparkSession, table: str, schema: str) -> None:
    """Make the table readable before its first batch."""
    spark.createDataFrame([], schema).drop(BATCH).write.mode("overwrite").parquet(f"{table}/{BATCH}=-1")


def put(df: DataFrame, table: str, batch_id: int, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{table}/{BATCH}={batch_id}")


def read(spark: SparkSession, table: str, schema: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Rows of the batches above ``after`` and up to ``upto``; only their folders are read."""
    rows = spark.read.schema(schema).parquet(table)
    if after is not None:
        rows = rows.where(F.col(BATCH) > after)
    return rows if upto is None else rows.where(F.col(BATCH) <= upto)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, table: str, name: str, finished: bool = False) -> list[int]:
    """The n of all folders ``name=n`` of a table; with ``finished`` only of those whose write ended."""
    fs, pattern = _files(spark, f"{table}/{name}=*" + ("/_SUCCESS" if finished else ""))
    found = fs.globStatus(pattern) or []
    parts = [str(s.getPath().toString()).removesuffix("/_SUCCESS").rsplit("=", 1)[1] for s in found]
    return sorted(int(p) for p in parts)


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)
