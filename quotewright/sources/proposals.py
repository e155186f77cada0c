"""The proposal history table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of blank fields.
DEFAULT_PROVIDER = "ollama"
DEFAULT_MODEL = "auto"


def _or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def history_rows(proposals: DataFrame) -> DataFrame:
    """Fill the defaults; empty sections are stored as NULL."""
    return proposals.withColumns({
        "client_name": _or_default(F.col("client_name"), ""),
        "provider": _or_default(F.col("provider"), DEFAULT_PROVIDER),
        "model": _or_default(F.col("model"), DEFAULT_MODEL),
        "sections_json": F.when(~F.trim("sections_json").isin("", "{}", "null"), F.col("sections_json")),
        "created_month": F.date_format("created_at", "yyyy-MM"),
    })


def append_proposals(proposals: DataFrame, path: str, batch: str) -> None:
    """Add history rows to the table at ``path``, one folder per month and batch.

    Only the folders of the months that ``batch``, the caller's name for this input, has are
    written, and they are replaced: running a batch again gives the same table. The
    rebalance lets Spark split busy months and join quiet ones by their real size.
    """
    rows = history_rows(proposals).withColumn("batch", F.lit(batch)).hint("rebalance", F.col("created_month"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("created_month", "batch").parquet(path)


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
