"""Scroll depth per user-day and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions.dates import parse_day
from footfall.functions.numbers import percent, round2
from footfall.functions.params import param_int
from footfall.operators.filters import of_events
from footfall.operators.user_days import count_users


def max_scroll(events: DataFrame, booked_on: Column) -> DataFrame:
    """Deepest scroll per (day, user) on any platform, 0 when it was not recorded."""
    scrolled = of_events(events, v.SCROLL).select(
        F.coalesce(parse_day(F.col("event_date")), booked_on).alias("Dates"),
        F.col("user_pseudo_id").alias("User_ID"),
        F.coalesce(param_int(v.PERCENT_SCROLLED), F.lit(0)).alias("percent_scrolled"),
    )
    return scrolled.groupBy("Dates", "User_ID").agg(F.max("percent_scrolled").alias("max_scroll_percent"))


def with_max_scroll(visits: DataFrame, deepest: DataFrame) -> DataFrame:
    """Visits, one per (day, user), with their deepest scroll or 0.

    Both sides are unique and grouped on the join keys, so the join adds no
    shuffle and no key can be hot.
    """
    joined = visits.join(deepest, ["Dates", "User_ID"], "left")
    return joined.withColumn("max_scroll_percent", F.coalesce("max_scroll_percent", F.lit(0).cast("bigint")))


def scroll_counts(visits: DataFrame, thresholds: Sequence[int] = v.SCROLL_THRESHOLDS) -> DataFrame:
    """Per day: all users, users who scrolled, and users at or past each threshold."""
    depth = F.col("max_scroll_percent")
    conditions = {"total_users": F.lit(True), "interacted_users": depth > 0}
    conditions |= {f"scrolled_{t}": depth >= t for t in thresholds}
    return count_users(visits, "Dates", "User_ID", conditions)


def bounce_percent() -> Column:
    return round2(percent(F.col("total_users") - F.col("interacted_users"), F.col("total_users")))


def threshold_percent(threshold: int) -> Column:
    """Share of the day's users past a threshold; NULL on days without any."""
    reached = F.col(f"scrolled_{threshold}")
    return round2(percent(F.nullif(reached, F.lit(0)), F.col("total_users")))
