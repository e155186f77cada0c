"""Running values over groups of any size: rows sorted by range, scanned per segment, chained.

A window over a whole group sends all of its rows to one task, however long the group is.
Here rows are range-partitioned by group and order, so a long group is spread over many
partitions, its segments. The sorted rows are written once with their segment, because
a range partitioning that is computed again may cut elsewhere. Each segment is
windowed alone. Totals of segments, a row each, are chained by a window per group, and
what comes before a segment corrects the values in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quotewright.sources import scratch

SEGMENT = "_segment"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = scratch.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_segments(rows: DataFrame, key: str, order: list[str], name: str, segments: int | None = None) -> DataFrame:
    """``rows`` with the number of their segment; numbers grow with (``key``, ``order``).

    ``segments`` fixes their number; else the session's shuffle partitions do, and small
    ones are joined. Rows that are equal in key and order stay in one segment.
    """
    by = [key, *order]
    dealt = rows.repartitionByRange(segments, *by) if segments else rows.repartitionByRange(*by)
    return written(dealt.withColumn(SEGMENT, F.spark_partition_id()), name)


def within(key: str, order: list[str]) -> WindowSpec:
    """The rows of a group's segment in their order."""
    return Window.partitionBy(key, SEGMENT).orderBy(*order)


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def earlier_segments(key: str) -> WindowSpec:
    """Over rows of totals, one per group and segment: the group's segments before this one."""
    return before(Window.partitionBy(key).orderBy(SEGMENT))
