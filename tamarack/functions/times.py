"""Functions of zone-less timestamps; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _elapsed(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01T00:00."""
    return _elapsed(ts, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def days_between(earlier: Column, later: Column) -> Column:
    """Elapsed days with their fraction."""
    return _elapsed(later, earlier) / F.lit(float(MICROS_PER_DAY))


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def year_of(ts: Column) -> Column:
    return F.year(ts)


def hour_start(ts: Column) -> Column:
    """The full hour that a zone-less timestamp lies in (date_trunc would pass through the session zone)."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))
