"""Stored files: listing and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.functions.dates import utc_iso
from quotewright.functions.text import size_kb

# Name patterns of proposals and cost reports.
PROPOSAL_FILES = "proposal_*.pdf"
REPORT_FILES = "cost_report_*.json"


def list_artifacts(spark: SparkSession, folder: str, pattern: str = PROPOSAL_FILES) -> DataFrame:
    """Name, time, size and address of the matching files of one folder, without its sub-folders.

    File contents are not read.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(folder)
        .select("path", "modificationTime", "length")
        .where(F.substring_index("path", "/", len(root.split("/"))) == root)
        .where(F.size(F.split("path", "/")) == len(root.split("/")) + 1)
    )
    name = F.substring_index("path", "/", -1)
    return files.select(
        name.alias("filename"),
        utc_iso(F.to_utc_timestamp("modificationTime", F.current_timezone())).alias("created_at"),
        F.col("length").alias("size_bytes"),
        size_kb(F.col("length")).alias("size_kb"),
        F.concat(F.lit("/proposals/"), name).alias("download_url"),
    )


def artifact_order(artifacts: DataFrame) -> DataFrame:
    """Newest names first."""
    return artifacts.orderBy(F.desc("filename"))
