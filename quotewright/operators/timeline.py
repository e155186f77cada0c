"""Timelines: totals, rescaling to the agreed number of weeks, Gantt offsets.

A timeline is either an array inside a response row (nothing is shuffled) or a
table with one row per phase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.operators.grouped import BLOCK_ROWS, heavy_rows, in_blocks, with_group_sums


def phase_totals(phases: DataFrame) -> DataFrame:
    """Weeks per proposal; entries that are not objects do not count."""
    return phases.groupBy("request_id").agg(
        F.count("*").alias("phases"),
        F.sum(F.when(F.col("is_object"), F.coalesce("weeks", F.lit(0))).otherwise(0)).alias("total_weeks"),
    )


def _scaled(weeks: Column, expected: Column, total: Column) -> Column:
    """Half-even rounding of ``weeks * (expected / total)``; keep this operand order."""
    ratio = expected.cast("double") / F.when(total != 0, total).cast("double")
    return F.greatest(F.lit(1).cast("bigint"), F.bround(weeks * ratio, 0).cast("bigint"))


def timeline_rescale(phases: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Scale the phases of each request so that they sum to ``expected_weeks``.

    The last phase takes the remainder, which may be below one week; such rows
    are flagged. If the last entry is not an object, nobody takes it.
    """
    counted = F.when(F.col("is_object"), F.coalesce("weeks", F.lit(0))).otherwise(0)
    blocked = in_blocks(phases, "seq", block_rows)
    heavy = heavy_rows(blocked, "request_id")

    def scaled(rows: DataFrame) -> DataFrame:
        summed = with_group_sums(rows, heavy, "request_id", "seq", {"given": counted})
        total, expected = F.col("given_total"), F.col("expected_weeks")
        return summed.withColumns({
            "_is_last": F.col("seq") == F.col("last_seq"),
            "_keep": (total == expected) | (total == 0) | ~F.col("is_object"),
            "_scaled": _scaled(F.coalesce("weeks", F.lit(0)), expected, total),
        }).drop("given_before", "last_seq")

    used = F.when(F.col("is_object") & ~F.col("_is_last"), F.col("_scaled")).otherwise(0)
    rescaled = with_group_sums(scaled(blocked), scaled(heavy), "request_id", "seq", {"used": used}).withColumn(
        "new_weeks",
        F.when(F.col("_keep"), F.col("weeks").cast("bigint"))
        .when(F.col("_is_last"), F.col("expected_weeks") - F.col("used_total"))
        .otherwise(F.col("_scaled")),
    )
    return rescaled.withColumn("is_infeasible", ~F.col("_keep") & (F.col("new_weeks") < 1)).drop(
        "_is_last", "_keep", "_scaled", "given_total", "used_total", "used_before", "last_seq",
        "_block",
    )


def rescale_array(timeline: Column, expected: Column) -> Column:
    """The same rule on an array of ``struct<is_object, phase, weeks, description>``."""
    zero = F.lit(0).cast("double")
    weeks = lambda p: F.when(p["is_object"], F.coalesce(p["weeks"], zero)).otherwise(zero)
    total = F.aggregate(timeline, zero, lambda acc, p: acc + weeks(p))
    ratio = expected / F.when(total != 0, total)
    scaled = lambda p: F.greatest(F.lit(1.0), F.bround(weeks(p) * ratio, 0))
    size = F.size(timeline)
    # The sum over all scaled entries; the last one is taken off again where it is used.
    used = F.aggregate(
        F.slice(timeline, F.lit(1), F.greatest(size - 1, F.lit(0))),
        zero, lambda acc, p: acc + F.when(p["is_object"], scaled(p)).otherwise(zero),
    )
    changed = F.transform(
        timeline,
        lambda p, i: p.withField(
            "weeks",
            F.when(~p["is_object"], p["weeks"])
            .when(i == size - 1, expected - used)
            .otherwise(scaled(p)),
        ),
    )
    return F.when((total == expected) | (total == 0) | (size <= 0), timeline).otherwise(changed)


def gantt_offsets(phases: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Start and end week per phase; timelines without any positive week are left out."""
    weeks = F.coalesce("weeks", F.lit(0))
    blocked = in_blocks(phases, "seq", block_rows)
    summed = with_group_sums(
        blocked, heavy_rows(blocked, "request_id"), "request_id", "seq",
        {"weeks": weeks, "positive": F.when(weeks > 0, 1).otherwise(0), "rows": F.lit(1)},
    )
    return summed.where("positive_total > 0").select(
        "request_id", "seq",
        F.coalesce("phase", F.concat(F.lit("Phase "), (F.col("rows_before") + 1).cast("string"))).alias("phase"),
        F.col("weeks_before").alias("start_week"),
        (F.col("weeks_before") + weeks).alias("end_week"),
        weeks.alias("weeks"),
    )
