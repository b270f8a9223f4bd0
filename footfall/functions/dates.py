"""Days, first-open days and ``m:ss`` durations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS_PER_DAY = 86_400_000


def parse_day(column: Column, fmt: str = "yyyyMMdd") -> Column:
    """DATE of a day written as text."""
    return F.to_date(column, fmt)


def format_day(column: Column) -> Column:
    """A DATE as ``yyyy-MM-dd`` text."""
    return F.date_format(column, "yyyy-MM-dd")


def compact_day(day: dt.date) -> str:
    """A Python date in the spelling of ``event_date``."""
    return day.strftime("%Y%m%d")


def utc_day_number(millis: Column) -> Column:
    """UTC day of epoch milliseconds, as days since 1970-01-01.

    Comparable with ``unix_date``. Values beyond the calendar give day numbers
    that no date has, so they need no range check, and no session zone is used.
    """
    return F.floor(millis / MILLIS_PER_DAY)


def report_day(report_date: dt.date | None) -> Column:
    """The day that rows without a date are booked on; today unless given."""
    return F.current_date() if report_date is None else F.lit(report_date)


def duration_seconds(column: Column, strict: bool = False) -> Column:
    """Seconds of ``m:ss`` text, 0 when there is none.

    Malformed text counts as 0; with ``strict=True`` it fails the query.
    """
    parts = F.split(column, ":")
    if strict:
        minutes, seconds = (F.element_at(parts, i).cast("bigint") for i in (1, 2))
        return F.coalesce(minutes * 60 + seconds, F.lit(0).cast("bigint"))
    minutes, seconds = (F.get(parts, i).try_cast("bigint") for i in (0, 1))
    total = F.try_add(F.try_multiply(minutes, F.lit(60).cast("bigint")), seconds)
    return F.coalesce(total, F.lit(0).cast("bigint"))
