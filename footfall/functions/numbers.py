"""Percentages, rounding and number display."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, on_zero: Literal["null", "zero"] = "null") -> Column:
    """``part / whole * 100``; NULL or 0 when ``whole`` is 0."""
    share = F.try_divide(part, whole)
    if on_zero == "zero":
        share = F.coalesce(share, F.lit(0.0))
    return share * 100


def round2(column: Column) -> Column:
    """Two decimals, halves to the even digit."""
    return F.bround(column, 2)


def show_count(column: Column, thousands: bool = True) -> Column:
    """No decimals, with or without thousands separators."""
    if thousands:
        return F.format_number(column, 0)
    return F.bround(column, 0).cast("bigint").cast("string")


def show_percent(column: Column) -> Column:
    """Two decimals and a percent sign, without thousands separators."""
    return F.concat(F.replace(F.format_number(column, 2), F.lit(","), F.lit("")), F.lit("%"))
