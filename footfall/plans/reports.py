"""The eight reports.

Daily reports have one row per day, newest first, with the day as ``dates``
(``yyyy-MM-dd`` text). Each scans its table once and shuffles once by
(day, user) and once by day; only daily rows are ordered. Filters and day
ranges act before users are counted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions import classify
from footfall.functions.dates import compact_day, format_day, parse_day, report_day
from footfall.functions.numbers import percent
from footfall.functions.params import param_int, param_string
from footfall.functions.rules import rule_number
from footfall.operators import goals as g
from footfall.operators.filters import (
    NO_FILTERS,
    PERSON,
    PLACES,
    VERSIONS,
    FilterSpec,
    apply_filters,
    between_booked_days,
    between_event_days,
    meets,
    of_events,
    on_android,
    where_selected,
    where_selected_or_unknown,
)
from footfall.operators.first_seen import first_seen_that_day, of_user_types, only_new, with_first_seen
from footfall.operators.long_form import daily_long, row_long
from footfall.operators.scroll import bounce_percent, max_scroll, scroll_counts, threshold_percent, with_max_scroll
from footfall.operators.guard import EmptyCheck
from footfall.operators.user_days import (
    count_users,
    has_any_label,
    has_label,
    label_number,
    null_if_absent,
    user_days,
)
from footfall.plans import extracts
from footfall.sinks.wide import turned_wide

Missing = Literal["zero", "null", "omit"]

WEB_COLUMNS = {"device": "Device", "country": "Country", "region": "Region", "city": "City"}
GOAL_COLUMNS = {category: v.snake(category) for category in (*v.GOAL_CATEGORIES, v.OTHERS)}
SOURCE_COLUMNS = {group: v.snake(group) for group in sorted(v.SOURCE_GROUPS)}
GOAL_TOTALS = ["total_users"]
SOURCE_TOTALS = ["total_logged_in_users", "users_who_set_goals"]


def newest_first(daily: DataFrame, day: Column, columns: Mapping[str, Column]) -> DataFrame:
    """Day as text and the given columns, newest day first; rows without a day go."""
    shown = daily.where(day.isNotNull()).select(
        format_day(day).alias("dates"), *(c.alias(name) for name, c in columns.items())
    )
    return shown.orderBy(F.desc("dates"))


def with_missing(daily: DataFrame, columns: Sequence[str], missing: Missing) -> DataFrame:
    """Applies a policy for label columns nobody appears in: 'zero' keeps them, 'null' empties them.

    What 'omit' leaves out is found in the finished report, see :func:`_as_asked`.
    """
    return null_if_absent(daily, columns) if missing == "null" else daily


def _as_asked(report: DataFrame, always: Sequence[str], missing: Missing) -> DataFrame:
    """The report; for 'omit' without the columns nobody appears in, which runs it once and stores nothing."""
    if missing != "omit":
        return report
    always = [c for c in report.columns if c in always]
    columns = [c for c in report.columns if c != "dates"]
    whole = [f.name for f in report.schema if f.dataType.typeName() == "long"]
    return turned_wide(daily_long(report, "dates", columns, always), always, whole)


def overview_counts(events: DataFrame) -> DataFrame:
    """Distinct users per ``event_date``: all, new, returning and by install type."""
    kind = F.col("user_type")
    conditions = {
        "total_users": F.lit(True),
        "new_users": kind != v.RETURNING_USER,
        "returning_users": kind == v.RETURNING_USER,
        "fresh_installs": kind == v.FRESH_INSTALL,
        "reinstalls": kind == v.REINSTALL,
        "users_with_custom_event": F.col("custom_event") == 1,
    }
    return count_users(extracts.classified_user_days(events), "event_date", "user_pseudo_id", conditions)


def overview(events: DataFrame, filters: FilterSpec = NO_FILTERS) -> DataFrame:
    """Active, new and returning users per day. A range needs both its ends."""
    spec = filters.only()
    if spec.start and spec.end:
        events = between_event_days(events, "event_date", spec.start, spec.end)
    daily = overview_counts(events)
    counts = {c: F.col(c) for c in daily.columns if c != "event_date"}
    return newest_first(daily, parse_day(F.col("event_date")), counts)


def funnel(
    daily: DataFrame, columns: Sequence[str], on_zero: Literal["null", "zero"], missing: Missing
) -> DataFrame:
    total = F.col("total_users")
    shares = {"total_users": total} | {c: percent(F.col(c), total, on_zero) for c in columns}
    report = newest_first(with_missing(daily, columns, missing), parse_day(F.col("event_date")), shares)
    return _as_asked(report, ["total_users"], missing)


def new_user_onboarding(
    events: DataFrame, filters: FilterSpec = NO_FILTERS, missing: Missing = "zero"
) -> DataFrame:
    """Onboarding steps as shares of each day's new users.

    New users and their steps come from the same table, so both are gathered
    per user-day in one pass and nothing is joined. Version and location belong
    to the steps: selecting one leaves out new users without a matching step.
    """
    spec = filters.only("install_type", *VERSIONS, *PLACES)
    rows = between_event_days(on_android(events), "event_date", spec.start, spec.end)
    rows = of_events(rows, v.FIRST_OPEN, *v.CUSTOM_EVENTS).withColumn("screen_name", param_string(v.SCREEN_NAME))

    event, screen = F.col("event_name"), F.col("screen_name")
    installed = event == v.FIRST_OPEN
    if spec.install_type:
        kind = classify.install_type(param_int(v.PREVIOUS_FIRST_OPEN_COUNT))
        installed = installed & kind.isin(list(spec.install_type))
    step = (event != v.FIRST_OPEN) & screen.isin(list(v.ONBOARDING_SCREENS))
    chosen = spec.selected(extracts.DIMENSIONS)
    for name, values in chosen.items():
        step = step & F.col(extracts.DIMENSIONS[name]).isin(values)
    number = F.when(step, rule_number(v.ONBOARDING_RULES, event, screen))

    reduced = user_days(
        rows,
        ["event_date", "user_pseudo_id"],
        number,
        len(v.ONBOARDING_LABELS),
        installed=F.max(installed),
    ).where("installed")
    matched = has_any_label() & F.col("user_pseudo_id").isNotNull()
    if chosen:
        reduced = reduced.where(matched)
    conditions = {v.snake(label): has_label(i) & matched for i, label in enumerate(v.ONBOARDING_LABELS)}
    conditions[v.snake(v.NO_CUSTOM_EVENT)] = ~matched
    daily = count_users(reduced, "event_date", "user_pseudo_id", {"total_users": F.lit(True), **conditions})
    return funnel(daily, list(conditions), "null", missing)


def total_user_onboarding(
    events: DataFrame, filters: FilterSpec = NO_FILTERS, missing: Missing = "zero"
) -> DataFrame:
    """Onboarding steps as shares of all users of each day."""
    spec = filters.only(*VERSIONS, *PLACES)
    rows = apply_filters(on_android(events), spec, "event_date", extracts.DIMENSIONS)
    rows = rows.withColumn("screen_name", param_string(v.SCREEN_NAME))

    labels = [*v.ONBOARDING_LABELS, v.NO_EVENT, v.NO_CUSTOM_EVENT]
    event, screen = F.col("event_name"), F.col("screen_name")
    number = (
        F.when(event.isNull(), labels.index(v.NO_CUSTOM_EVENT) + 1)
        .when(screen.isNull(), labels.index(v.NO_EVENT) + 1)
        .otherwise(rule_number(v.ONBOARDING_RULES, event, screen))
    )
    reduced = user_days(rows, ["event_date", "user_pseudo_id"], number, len(labels))
    conditions = {v.snake(label): has_label(i) for i, label in enumerate(labels)}
    daily = count_users(reduced, "event_date", "user_pseudo_id", {"total_users": F.lit(True), **conditions})
    return funnel(daily, list(conditions), "zero", missing)


def explore_columns() -> tuple[list[str], list[str], list[str]]:
    """Column names: actions shown first, watch buckets, actions shown last."""
    actions = [v.snake(label) for label in v.EXPLORE_LABELS]
    cut = len(actions) - v.EXPLORE_LABELS_AFTER_WATCH
    return actions[:cut], [v.snake(label) for label in v.WATCH_LABELS], actions[cut:]


def explore_counts(rows: DataFrame) -> DataFrame:
    """Users per day in all, per action and per watch bucket, from one reduction."""
    labels = v.EXPLORE_LABELS
    reduced = user_days(
        rows,
        ["event_date", "user_id"],
        F.col("action_number"),
        len(labels),
        watched=F.max("duration_seconds"),
    ).withColumn("bucket", classify.watch_bucket(F.col("watched")))
    conditions = {"total_users": F.lit(True)}
    conditions |= {v.snake(label): has_label(i) for i, label in enumerate(labels)}
    conditions |= {v.snake(label): F.col("bucket") == label for label in v.WATCH_LABELS}
    return count_users(reduced, "event_date", "user_id", conditions)


def explore_journey(
    events: DataFrame,
    filters: FilterSpec = NO_FILTERS,
    missing: Missing = "omit",
    strict_duration: bool = False,
) -> DataFrame:
    """First-day explore actions and watch buckets as shares of each day's users."""
    spec = filters.only(*VERSIONS, *PLACES, *PERSON)
    rows = between_event_days(events, "event_date", spec.start, spec.end)
    rows = extracts.explore_rows(rows, strict_duration)
    daily = explore_counts(where_selected(rows, spec.selected([*VERSIONS, *PLACES, *PERSON])))

    first, watch, last = explore_columns()
    total = F.col("total_users")
    shares = {"total_users": total} | {c: percent(F.col(c), total, "zero") for c in (*first, *watch, *last)}
    report = newest_first(with_missing(daily, [*first, *last], missing), parse_day(F.col("event_date")), shares)
    return _as_asked(report, ["total_users", *watch], missing)


def explore_journey_long(events: DataFrame, filters: FilterSpec = NO_FILTERS, strict_duration: bool = False) -> DataFrame:
    """The same as (dates, position, column, value), without actions nobody did; lazy."""
    wide = explore_journey(events, filters, "zero", strict_duration)
    _, watch, _ = explore_columns()
    return daily_long(wide, "dates", wide.columns[1:], ["total_users", *watch])


def _web_in_range(web: DataFrame, spec: FilterSpec, booked_on: Column) -> DataFrame:
    start, end = (None if day is None else F.lit(day) for day in (spec.start, spec.end))
    return between_booked_days(web, F.col("Dates"), start, end, booked_on)


def scrolls_in_range(rows: DataFrame, spec: FilterSpec, booked_on: Column) -> DataFrame:
    """Rows by ``event_date`` that a scroll report may need; those without a day count as ``booked_on``."""
    start, end = (None if day is None else F.lit(compact_day(day)) for day in (spec.start, spec.end))
    return between_booked_days(rows, F.col("event_date"), start, end, F.date_format(booked_on, "yyyyMMdd"))


def scroll_depth_of(
    deepest: DataFrame, web: DataFrame, new_user: DataFrame, spec: FilterSpec, booked_on: Column
) -> DataFrame:
    """:func:`scroll_depth` with the deepest scroll per (``Dates``, ``User_ID``) given."""
    visits = extracts.on_web_events(_web_in_range(web, spec.only("user_type"), booked_on))
    if only_new(list(spec.user_type)):  # these have a day, so it is not filled in and the layout stays
        visits = first_seen_that_day(extracts.user_days_of(visits), new_user)
    else:
        if spec.user_type:
            visits = of_user_types(with_first_seen(extracts.user_days_of(visits), new_user), list(spec.user_type))
        visits = extracts.user_days_of(visits.withColumn("Dates", F.coalesce("Dates", booked_on)))
    daily = scroll_counts(with_max_scroll(visits, deepest))
    columns = {"total_users": F.col("total_users"), "interacted_users": F.col("interacted_users")}
    columns["bounce_pct"] = bounce_percent()
    columns |= {f"scrolled_{t}_pct": threshold_percent(t) for t in v.SCROLL_THRESHOLDS}
    return newest_first(daily, F.col("Dates"), columns)


def scroll_depth(
    events: DataFrame,
    web: DataFrame,
    new_user: DataFrame,
    filters: FilterSpec = NO_FILTERS,
    report_date: dt.date | None = None,
) -> DataFrame:
    """Bounce rate and scroll depth of each day's web users."""
    booked_on = report_day(report_date)
    deepest = max_scroll(scrolls_in_range(events, filters, booked_on), booked_on)
    return scroll_depth_of(deepest, web, new_user, filters, booked_on)


def web_events(
    web: DataFrame,
    new_user: DataFrame,
    filters: FilterSpec = NO_FILTERS,
    report_date: dt.date | None = None,
    missing: Missing = "null",
) -> DataFrame:
    """Web users per listed event and day; all unidentified users count as one."""
    spec = filters.only("user_type", *WEB_COLUMNS)
    booked_on = report_day(report_date)
    rows = extracts.on_web_events(_web_in_range(web, spec, booked_on))
    rows = where_selected_or_unknown(
        rows, {WEB_COLUMNS[name]: values for name, values in spec.selected(WEB_COLUMNS).items()}
    )
    names = {label: v.snake(label) for label in v.WEB_EVENTS}
    new = only_new(list(spec.user_type))
    if spec.user_type and not new:
        rows = rows.select("Dates", "User_ID", "Event_Name").distinct()
        rows = of_user_types(with_first_seen(rows, new_user), list(spec.user_type))
    if not new:  # new users have a day
        rows = rows.withColumn("Dates", F.coalesce("Dates", booked_on))
    reduced = user_days(rows, ["Dates", "User_ID"], label_number(F.col("Event_Name"), list(names)), len(names))
    if new:
        reduced = first_seen_that_day(reduced, new_user)
    daily = count_users(
        reduced,
        "Dates",
        "User_ID",
        {name: has_label(i) for i, name in enumerate(names.values())},
        count_missing_user=True,
    )
    daily = with_missing(daily, list(names.values()), missing)
    return _as_asked(newest_first(daily, F.col("Dates"), {c: F.col(c) for c in names.values()}), [], missing)


GOAL_FILTERS = (*VERSIONS, *PLACES, *PERSON)


def latest_goals(
    extract: DataFrame, filters: FilterSpec = NO_FILTERS, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Each user's latest goal within the filters, from a goal extract."""
    spec = filters.only(*GOAL_FILTERS)
    rows = apply_filters(extract, spec, "event_date", {name: name for name in GOAL_FILTERS})
    return g.latest_goal(g.goal_clicks(rows), tiebreak)


def goal_categories(
    extract: DataFrame,
    filters: FilterSpec = NO_FILTERS,
    tiebreak: Sequence[str] = (),
    missing: Literal["null", "omit"] = "null",
) -> DataFrame:
    """One row: users with a goal and the share of each category of their latest goal.

    With 'omit', absent categories are left out and the rest ordered by share, which runs the
    report; :func:`goal_categories_long` stays lazy. ``extract`` comes from ``extracts.goal_rows``.
    """
    if missing == "omit":
        return turned_wide(goal_categories_long(extract, filters, tiebreak), GOAL_TOTALS)
    return g.goals_wide(latest_goals(extract, filters, tiebreak), GOAL_COLUMNS)


def goal_categories_long(
    extract: DataFrame, filters: FilterSpec = NO_FILTERS, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The same as (position, column, value): users with a goal, then the categories there are by falling share; lazy."""
    wide = goal_categories(extract, filters, tiebreak)
    return row_long(wide, wide.columns, GOAL_TOTALS, by_value=True)


def custom_goals(
    extract: DataFrame, filters: FilterSpec = NO_FILTERS, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Distinct goal texts among the latest goals that fit no category."""
    return g.other_goals(latest_goals(extract, filters, tiebreak))


def goal_sources(
    extract: DataFrame, filters: FilterSpec = NO_FILTERS, missing: Literal["null", "omit"] = "null"
) -> DataFrame:
    """One row: logged-in users, users with a goal, and the share of each entry source."""
    if missing == "omit":
        return turned_wide(goal_sources_long(extract, filters), SOURCE_TOTALS)
    spec = filters.only(*GOAL_FILTERS)
    rows = apply_filters(extract, spec, "event_date", {name: name for name in GOAL_FILTERS})
    return g.source_shares(rows, SOURCE_COLUMNS)


def goal_sources_long(extract: DataFrame, filters: FilterSpec = NO_FILTERS) -> DataFrame:
    """The same as (position, column, value): both totals, then the entry sources there are; lazy."""
    wide = goal_sources(extract, filters)
    return row_long(wide, wide.columns, SOURCE_TOTALS)


def goal_reports(
    extract: DataFrame,
    goal_filters: FilterSpec = NO_FILTERS,
    source_filters: FilterSpec = NO_FILTERS,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Both goal reports from one pass, each with its own filters, as one row of structs ``goals`` and ``sources``.

    The extract is read once and shuffled once by user, and nothing is stored.
    """
    names = {name: name for name in GOAL_FILTERS}
    in_goals, in_sources = (meets(spec.only(*GOAL_FILTERS), "event_date", names) for spec in (goal_filters, source_filters))
    return g.goals_and_sources(extract, in_goals, in_sources, GOAL_COLUMNS, SOURCE_COLUMNS, tiebreak)


def checked_goal_reports(
    extract: DataFrame,
    goal_filters: FilterSpec = NO_FILTERS,
    source_filters: FilterSpec = NO_FILTERS,
    tiebreak: Sequence[str] = (),
) -> tuple[DataFrame, EmptyCheck]:
    """:func:`goal_reports` and what its own run says about rows before and after the filters."""
    names = {name: name for name in GOAL_FILTERS}
    in_goals, in_sources = (meets(spec.only(*GOAL_FILTERS), "event_date", names) for spec in (goal_filters, source_filters))
    check = EmptyCheck(
        {
            "extract": F.lit(True),
            "goals": in_goals,
            "goal_clicks": in_goals & g.is_goal_click(),
            "sources": in_sources,
            "known_sources": in_sources & g.is_known_source(SOURCE_COLUMNS),
        }
    )
    return g.goals_and_sources(extract, in_goals, in_sources, GOAL_COLUMNS, SOURCE_COLUMNS, tiebreak, check), check
