"""Session settings the operators are written for. All of them can be set at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins by real sizes, split skewed join partitions, join small ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles methods above 8000 bytes; beyond that use split code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A repeated JSON key keeps its last value instead of making the reply unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
