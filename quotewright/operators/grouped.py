"""Group totals and running sums that hold when one group is very large.

A window over a whole group would send all of its rows to one task. Rows carry
a position within their group, so they are windowed by (group, block of
positions) instead. A block is bounded. Groups that reach a second block are
summed per block, and those few sums correct the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.functions.money import div

BLOCK_ROWS = 65_536


def in_blocks(rows: DataFrame, seq: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return rows.withColumn("_block", div(F.col(seq), block_rows))


def heavy_rows(blocked: DataFrame, key: str) -> DataFrame:
    """Rows of the groups that reach a second block, usually none.

    Their keys are few where positions are dense; the adaptive planner broadcasts
    them when they measure small.
    """
    keys = blocked.where(F.col("_block") >= 1).select(key).distinct()
    return blocked.join(keys, key, "left_semi")


def with_group_sums(
    blocked: DataFrame, heavy: DataFrame, key: str, seq: str, measures: dict[str, Column]
) -> DataFrame:
    """Add ``<name>_total`` and ``<name>_before`` for every measure.

    ``total`` is the sum over the group and ``before`` the sum over the rows with
    a smaller ``seq``; ``last_<seq>`` is the largest position. ``seq`` numbers the
    rows of a group from 0 or 1 on. ``blocked`` comes from ``in_blocks``, and
    ``heavy`` holds its rows from ``heavy_rows`` with the same columns. Calls on
    the same blocks share one shuffle.
    """
    whole = Window.partitionBy(key, "_block")
    earlier = whole.orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    local = {f"last_{seq}": F.max(seq).over(whole)}
    for name, value in measures.items():
        local[f"{name}_total"] = F.coalesce(F.sum(value).over(whole), zero)
        local[f"{name}_before"] = F.coalesce(F.sum(value).over(earlier), zero)
    windowed = blocked.withColumns(local)

    sums = heavy.groupBy(key, "_block").agg(
        F.max(seq).alias("_last"),
        *[F.coalesce(F.sum(value), zero).alias(f"_{name}") for name, value in measures.items()],
    )
    group = Window.partitionBy(key)
    previous = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fixes = [F.max("_last").over(group).alias("_fix_last")]
    for name in measures:
        fixes.append(F.sum(f"_{name}").over(group).alias(f"_fix_{name}_total"))
        fixes.append(F.sum(f"_{name}").over(previous).alias(f"_fix_{name}_before"))
    joined = windowed.join(sums.select(key, "_block", *fixes), [key, "_block"], "left")

    final = {f"last_{seq}": F.coalesce("_fix_last", f"last_{seq}")}
    for name in measures:
        final[f"{name}_total"] = F.coalesce(f"_fix_{name}_total", f"{name}_total")
        final[f"{name}_before"] = F.col(f"{name}_before") + F.coalesce(f"_fix_{name}_before", zero)
    return joined.withColumns(final).drop(*[c for c in joined.columns if c.startswith("_fix_")])
