"""Dates and instants. "Now" and "today" are always arguments, never read from the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yesterday(today: Column) -> Column:
    return F.date_sub(today, 1)


def year_of(text: Column) -> Column:
    """Year of an ISO date or date-time text; null when it is not one."""
    return F.year(text.try_cast("date"))


def instant(text: Column) -> Column:
    """ISO text to an instant; text without a zone is read as UTC (the session zone)."""
    return F.try_to_timestamp(text)


def run_time(start: Column, lead_minutes: int) -> Column:
    """Instant ``lead_minutes`` before ``start``."""
    return start - F.make_dt_interval(mins=F.lit(lead_minutes))


def in_zone(moment: Column, zone: str) -> Column:
    """Wall-clock rendering of a UTC instant in ``zone``."""
    return F.from_utc_timestamp(moment, zone)


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours from ``earlier`` to ``later``."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000)
