"""Row-level extracts: what each report reads, before filters and counting.

All are lazy. A report that starts from one only pays for the columns it uses.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions import classify
from footfall.functions.dates import duration_seconds, parse_day, report_day, utc_day_number
from footfall.functions.params import explode_params, param_int, param_string, property_int, property_string
from footfall.operators.filters import of_events, on_android
from footfall.operators.first_seen import as_user_types, with_first_seen
from footfall.operators.scroll import max_scroll, with_max_scroll

DIMENSIONS = {
    "os_version": "device.operating_system_version",
    "app_version": "app_info.version",
    "country": "geo.country",
    "region": "geo.region",
    "city": "geo.city",
}


def dimensions() -> list[Column]:
    """Version and location fields, flat."""
    return [F.col(path).alias(name) for name, path in DIMENSIONS.items()]


def user_day_flags(events: DataFrame) -> DataFrame:
    """Per Android (day, user): opened first, earlier first opens, did a custom event.

    Only first opens spread out into all their parameters.
    """
    first_open = F.col("event_name") == v.FIRST_OPEN
    count_param = first_open & (F.col("param.key") == v.PREVIOUS_FIRST_OPEN_COUNT)
    return (
        explode_params(on_android(events), only_where=first_open)
        .groupBy("event_date", "user_pseudo_id")
        .agg(
            F.max(F.when(first_open, 1).otherwise(0)).alias("had_first_open"),
            F.max(F.when(count_param, F.col("param.int_value"))).alias("previous_first_open_count"),
            F.max(F.when(F.col("event_name").isin(list(v.CUSTOM_EVENTS)), 1).otherwise(0)).alias("custom_event"),
        )
    )


def classified_user_days(events: DataFrame) -> DataFrame:
    """The same with the user type of the day."""
    kind = classify.user_type(F.col("had_first_open"), F.col("previous_first_open_count"))
    return user_day_flags(events).withColumn("user_type", kind)


def new_installs(events: DataFrame) -> DataFrame:
    """First opens on Android with their install type."""
    return of_events(on_android(events), v.FIRST_OPEN).select(
        "event_date", "user_pseudo_id", classify.install_type(param_int(v.PREVIOUS_FIRST_OPEN_COUNT)).alias("install_type")
    )


def onboarding_events(events: DataFrame) -> DataFrame:
    """Custom events on the onboarding screens, on Android."""
    return (
        of_events(on_android(events), *v.CUSTOM_EVENTS)
        .withColumn("screen_name", param_string(v.SCREEN_NAME))
        .where(F.col("screen_name").isin(list(v.ONBOARDING_SCREENS)))
        .select("event_date", "user_pseudo_id", "event_name", "screen_name", *dimensions())
    )


def new_user_rows(events: DataFrame) -> DataFrame:
    """New installs left joined with the user's onboarding events of the same day.

    Equal rows are counted on both sides before they meet, and ``n_rows`` is
    the number of joined rows each result row stands for. Repeated events of
    one user-day so never multiply.
    """
    keys = ["event_date", "user_pseudo_id"]
    installs = new_installs(events)
    installs = installs.groupBy(*installs.columns).agg(F.count("*").alias("n_installs"))
    seen = onboarding_events(events).where(F.col("user_pseudo_id").isNotNull())
    seen = seen.groupBy(*seen.columns).agg(F.count("*").alias("n_events"))
    return (
        installs.join(seen, keys, "left")
        .withColumn("descriptive_event", classify.onboarding_label(F.col("event_name"), F.col("screen_name")))
        .withColumn("n_rows", F.col("n_installs") * F.coalesce("n_events", F.lit(1).cast("bigint")))
        .drop("n_installs", "n_events")
    )


def total_user_rows(events: DataFrame) -> DataFrame:
    """Every Android event with its onboarding label, NULL off the list without a screen."""
    return (
        on_android(events)
        .withColumn("screen_name", param_string(v.SCREEN_NAME))
        .select(
            "event_date",
            "user_pseudo_id",
            "event_name",
            "screen_name",
            *dimensions(),
            classify.onboarding_label(F.col("event_name"), F.col("screen_name")).alias("app_event"),
        )
    )


def logged_in_by_property(events: DataFrame) -> DataFrame:
    """Events whose user properties carry a user id, as ``user_id``."""
    return events.withColumn("user_id", property_string(v.USER_ID)).where(F.col("user_id").isNotNull())


def logged_in_by_param(events: DataFrame) -> DataFrame:
    """Events whose parameters carry a user id, as ``user_id``."""
    return events.withColumn("user_id", param_string(v.USER_ID)).where(F.col("user_id").isNotNull())


def on_first_day(events: DataFrame) -> DataFrame:
    """Events on the UTC day their user first opened the app."""
    first_day = utc_day_number(property_int(v.FIRST_OPEN_TIME))
    return events.where(F.unix_date(parse_day(F.col("event_date"))) == first_day)


def explore_rows(events: DataFrame, strict_duration: bool = False) -> DataFrame:
    """First-day explore actions of logged-in users with label and watched seconds."""
    named = of_events(on_android(events), *dict.fromkeys(rule.event for rule in v.EXPLORE_RULES))

    def or_na(key: str) -> Column:
        return F.coalesce(property_string(key), F.lit(v.NOT_AVAILABLE))

    return (
        on_first_day(logged_in_by_property(named))
        .withColumn("screen_name", param_string(v.SCREEN_NAME))
        .withColumn("view_id", param_string(v.VIEW_ID))
        .withColumn("action_number", classify.explore_number(*map(F.col, ("event_name", "screen_name", "view_id"))))
        .where(F.col("action_number") > 0)
        .select(
            "event_date",
            "user_id",
            or_na(v.USER_AGE).alias("age"),
            or_na(v.USER_PROFESSION).alias("profession"),
            or_na(v.USER_GENDER).alias("gender"),
            "action_number",
            classify.label_of(F.col("action_number"), v.EXPLORE_LABELS).alias("actions"),
            duration_seconds(param_string(v.DURATION), strict_duration).alias("duration_seconds"),
            *dimensions(),
        )
    )


def on_web_events(web: DataFrame) -> DataFrame:
    """Rows of the listed web events."""
    return of_events(web, *v.WEB_EVENTS, column="Event_Name")


def web_rows(web: DataFrame, new_user: DataFrame, report_date: dt.date | None = None) -> DataFrame:
    """Web activity with user type; missing values filled in.

    Equal rows are counted before they meet the first-seen table, and
    ``n_rows`` is the number of joined rows each result row stands for.
    """
    listed = on_web_events(web)
    listed = listed.groupBy("Dates", "Event_Name", "Device", "Country", "Region", "City", "User_ID").agg(
        F.count("*").alias("n_rows")
    )
    typed = as_user_types(with_first_seen(listed, new_user), copies=F.col("n_rows"))
    unknown = {c: F.coalesce(c, F.lit(v.UNKNOWN)) for c in ("Device", "Country", "Region", "City")}
    return typed.withColumns({"Dates": F.coalesce("Dates", report_day(report_date)), **unknown})


def user_days_of(web: DataFrame) -> DataFrame:
    """Distinct (day, user) of web activity."""
    return web.select("Dates", "User_ID").distinct()


def scroll_rows(
    events: DataFrame, web: DataFrame, new_user: DataFrame, report_date: dt.date | None = None
) -> DataFrame:
    """Distinct (day, user, user type) of web visits with the deepest scroll."""
    booked_on = report_day(report_date)
    typed = as_user_types(with_first_seen(user_days_of(on_web_events(web)), new_user)).drop("n_rows")
    visits = typed.withColumn("Dates", F.coalesce("Dates", booked_on)).distinct()
    return with_max_scroll(visits, max_scroll(events, booked_on))


def goal_rows(events: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Android events of logged-in users with what the goal reports read."""
    return logged_in_by_param(on_android(events)).select(
        "event_date",
        "user_id",
        property_string(v.USER_GENDER).alias("gender"),
        property_string(v.USER_AGE).alias("age"),
        property_string(v.USER_PROFESSION).alias("profession"),
        "event_name",
        param_string(v.SCREEN_NAME).alias("screen_name"),
        param_string(v.SOURCE).alias("sources"),
        param_string(v.GOAL_SELECTED).alias("goal_selected"),
        param_int(v.IS_CUSTOM_GOAL).alias("is_custom_goal"),
        *dimensions(),
        *tiebreak,
    )
