"""Evaluate an expression once per row where the optimizer would repeat it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when a lambda inside uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row.

    Filters and projections that use a plain projected column repeat its
    expression. They cannot reach through a generator, here one of a single row.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def once_compiled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``once`` for small values that need lambdas.

    A generator with a lambda in it is interpreted as a whole. Here a projection makes
    the values, which is compiled around the lambdas; the generator only unpacks them.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    packed = df.select("*", values.alias("_once"))
    return packed.select(*[packed[f"`{name}`"] for name in df.columns], F.inline(F.array("_once")))
