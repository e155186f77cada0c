"""Money as whole paise. Integer arithmetic keeps every component exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer division; ``/`` would go through double."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def round_div(a: Column, b: Column | int) -> Column:
    """``a / b`` rounded half up to a whole number, for ``a >= 0`` and ``b > 0``."""
    b = F.lit(b) if isinstance(b, int) else b
    return div(2 * a + b, 2 * b)


def hundredths_text(c: Column) -> Column:
    """Hundredths as the shortest decimal text: 135 -> 1.35, 140 -> 1.4, 100 -> 1.0."""
    whole, cents = div(c, 100).cast("string"), c % 100
    part = (
        F.when(cents % 10 == 0, div(cents, 10).cast("string"))
        .otherwise(F.lpad(cents.cast("string"), 2, "0"))
    )
    return F.concat(whole, F.lit("."), part)


def fraction_text(bps: Column) -> Column:
    """Basis points as the shortest fraction: 1500 -> 0.15, 1000 -> 0.1, 1250 -> 0.125, 12000 -> 1.2."""
    rest = F.rtrim(F.lpad((bps % 10_000).cast("string"), 4, "0"), F.lit("0"))
    return F.concat(div(bps, 10_000).cast("string"), F.lit("."), F.when(rest == "", "0").otherwise(rest))


def percent_text(bps: Column) -> Column:
    """Basis points as the shortest percent: 1500 -> 15, 1250 -> 12.5, 1205 -> 12.05."""
    rest = F.rtrim(F.lpad((bps % 100).cast("string"), 2, "0"), F.lit("0"))
    return F.concat(div(bps, 100).cast("string"), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))


def rupees(paise: Column) -> Column:
    """Paise as an exact decimal amount of rupees."""
    return (paise / F.lit(100).cast("decimal(3,0)")).cast("decimal(24,2)")


def amount_text(paise: Column) -> Column:
    """Paise as ``1,234,567.89``."""
    return F.concat(
        F.format_number(div(paise, 100), 0), F.lit("."),
        F.lpad((paise % 100).cast("string"), 2, "0"),
    )
