"""Project requests as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"
TEXT_FIELDS = (
    "project_title", "industry", "client_name", "provider", "model", "custom_notes", "budget_range",
    "project_priority", "deployment_model", "target_audience", "competitors", "device_id", "user_name",
)
# Numbers are read as text first, so that "12" and 12 both arrive.
READ_SCHEMA = ", ".join([
    "request_id bigint", "duration_months string", "expected_users string",
    "tech_stack array<string>", "compliance_requirements array<string>",
    *[f"{name} string" for name in TEXT_FIELDS], f"{CORRUPT} string",
])


def _typed(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "duration_months": F.col("duration_months").try_cast("int"),
        "expected_users": F.col("expected_users").try_cast("bigint"),
        "provider": F.coalesce("provider", F.lit("ollama")),
    })


def _options(reader):
    return reader.schema(READ_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Undeclared keys are ignored; lines that are not JSON keep their text in ``_corrupt``."""
    return _typed(_options(spark.read).json(path))


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_options(spark.readStream).json(path))
