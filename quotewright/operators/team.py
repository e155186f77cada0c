"""Team composition: rule-driven roles, then the industry's own role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright import seeds
from quotewright.functions.binding import once
from quotewright.functions.industry import resolve_industry
from quotewright.functions.money import div

FULL, PART = "Full-time", "Part-time"


def _member(role: str | Column, headcount: int | Column, allocation: str | Column) -> Column:
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        as_col(role).alias("role"),
        as_col(headcount).cast("int").alias("headcount"),
        as_col(allocation).alias("allocation"),
    )


def estimate_team(requests: DataFrame) -> DataFrame:
    """Add ``team``, an array of roles in their fixed order. No shuffle."""
    months, users = F.col("duration_months"), F.col("expected_users")
    has_frontend = F.exists("tech_stack", lambda t: F.lower(t).isin(*seeds.FRONTEND_STACKS))
    resolved = once(requests, {"_team_industry": resolve_industry(F.col("industry"))})
    found = seeds.lookup(
        resolved, seeds.industry_extra_roles(requests.sparkSession), "_team_industry"
    )
    rules = [
        _member("Project Manager", 1, FULL),
        _member("Backend Developer", F.greatest(F.lit(1), div(months + 2, 3)), FULL),
        _member("Frontend Developer", F.greatest(F.lit(1), div(months + 3, 4)), FULL),
        _member("QA Engineer", F.when(months <= 4, 1).otherwise(2), FULL),
        F.when((months >= 4) | (users >= 5_000), _member("DevOps Engineer", 1, PART)),
        F.when(has_frontend, _member("UI/UX Designer", 1, PART)),
        F.when(users >= 10_000, _member("Database Administrator", 1, PART)),
        F.when((months >= 6) | (users >= 50_000), _member("Solution Architect", 1, PART)),
        F.when(months >= 4, _member("Business Analyst", 1, PART)),
        F.when(F.col("role").isNotNull(), _member(F.col("role"), F.col("headcount"), F.col("allocation"))),
    ]
    return found.withColumn("team", F.array_compact(F.array(*rules))).drop(
        "_team_industry", "role", "headcount", "allocation"
    )


def team_rows(teams: DataFrame) -> DataFrame:
    """One row per role with its 1-based position."""
    return teams.select("request_id", F.posexplode("team").alias("at", "member")).select(
        "request_id", (F.col("at") + 1).alias("pos"), "member.*"
    )


def extra_roles_join(requests: DataFrame) -> DataFrame:
    """The industry role of each request that has one."""
    resolved = once(requests, {"industry_applied": resolve_industry(F.col("industry"))})
    roles = seeds.industry_extra_roles(requests.sparkSession)
    return seeds.lookup(resolved, roles, "industry_applied", how="inner").select(
        "request_id", "industry_applied", "role", "headcount", "allocation"
    )


def headcount_value(count_text: Column) -> Column:
    """A head count that may be a range: ``2-3`` counts as 2."""
    return F.split(count_text.cast("string"), "-")[0].cast("int")


def team_headcount(rows: DataFrame) -> DataFrame:
    """Heads per role over all teams."""
    totals = rows.groupBy(F.coalesce("role", F.lit("Unknown")).alias("role")).agg(
        F.count("*").alias("teams"),
        F.sum(headcount_value(F.coalesce(F.col("headcount").cast("string"), F.lit("1")))).alias("heads"),
    )
    return totals.where("heads > 0")
