"""Cost reports as JSON rows and as long ``key,value`` CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from quotewright.operators.pricing import COST_PARTS
from quotewright.operators.reports import cost_report_kv

# Report keys. Older files lack the last ones.
NUMBER_KEYS = COST_PARTS
TEXT_KEYS = ("currency", "industry_applied", "cost_adjustment_reason")
DETAILS_SCHEMA = (
    "duration_months bigint, expected_users bigint, infra_per_user double, dev_rate_per_month double, "
    "contingency_pct double, discount_pct double, industry_dev_multiplier double, "
    "industry_infra_multiplier double"
)


def _written(rows: DataFrame, path: str, batch: str | None) -> tuple[DataFrameWriter, str]:
    """Append, or replace the folder of ``batch``, so that a job that runs again does not double its rows."""
    if batch is None:
        return rows.write.mode("append"), path
    return rows.write.mode("overwrite"), f"{path}/batch={batch}"


def write_cost_reports_json(estimates: DataFrame, path: str, batch: str | None = None) -> None:
    """One JSON object per estimate."""
    writer, folder = _written(estimates, path, batch)
    writer.json(folder)


def write_cost_reports_csv(estimates: DataFrame, path: str, batch: str | None = None) -> None:
    """``report_id,key,value`` rows of all estimates, spread over as many files as there are tasks."""
    rows = cost_report_kv(estimates).select(F.col("request_id").alias("report_id"), "key", "value")
    writer, folder = _written(rows, path, batch)
    writer.option("header", True).option("escape", '"').csv(folder)


def read_cost_reports(spark: SparkSession, path: str, has_report_id: bool = False) -> DataFrame:
    """Long CSV reports as one wide row per report.

    A report is one file, named by its whole path, or one ``report_id`` where the rows
    carry it. Keys that a file does not have become NULL.
    """
    columns = "report_id string, key string, value string" if has_report_id else "key string, value string"
    rows = (
        spark.read.schema(columns).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    )
    if not has_report_id:
        rows = rows.withColumn("report_id", F.col("_metadata.file_path"))
    values = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in (*NUMBER_KEYS, *TEXT_KEYS, "details")]
    wide = rows.groupBy("report_id").agg(*values)
    return wide.withColumns({
        **{k: F.col(k).try_cast("double") for k in NUMBER_KEYS},
        "details": F.from_json("details", DETAILS_SCHEMA),
    })
