"""Date labels. The reference date is always an argument, never today's date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def month_label(as_of: Column) -> Column:
    return F.date_format(as_of, "MMMM yyyy")


def long_date(as_of: Column) -> Column:
    return F.date_format(as_of, "MMMM dd, yyyy")


def utc_iso(ts: Column) -> Column:
    """ISO text in UTC; the fraction is left out when it is zero."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts.cast("timestamp_ntz"))


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def is_new(created_at: Column, as_of: Column) -> Column:
    """Created less than 24 hours before ``as_of``."""
    return epoch_micros(as_of) - epoch_micros(created_at) < 86_400_000_000


def expected_weeks(duration_months: Column) -> Column:
    return duration_months * 4
