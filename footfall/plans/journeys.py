"""The Android reports of a day from one scan and one reduction.

Overview, onboarding of new users, onboarding of all users and the deepest scroll all ask what a user
did on a day. Every event is therefore marked once for all of them: flags, labels as bits, and two
numbers. Marks merge (bits by OR, numbers by MAX), so rows may be events, or the stored state of user
days (``footfall.sources.state``), or both; the reports cannot tell. Filters become conditions inside the one
reduction by (day, user), each report with its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions import classify
from footfall.functions.dates import compact_day, parse_day, report_day
from footfall.functions.params import param_int, param_string
from footfall.functions.rules import rule_number
from footfall.operators.filters import NO_FILTERS, PLACES, VERSIONS, FilterSpec, meets
from footfall.plans import extracts, reports

KEYS = ("event_date", "user_pseudo_id")
LABELS = (*v.ONBOARDING_LABELS, v.NO_EVENT, v.NO_CUSTOM_EVENT)
ON_ANDROID, ACTIVE, OPENED, CUSTOM, FRESH, REINSTALLED, STEPPED = (1 << i for i in range(7))
INSTALLS = {v.FRESH_INSTALL: FRESH, v.REINSTALL: REINSTALLED}
REPORTS = ("overview", "new_user_onboarding", "total_user_onboarding")


def marks(events: DataFrame) -> DataFrame:
    """One row per Android or scroll event: day, user, version and place, ``flags``, ``labels``, ``earlier``, ``scroll``.

    ``flags`` say what kind of event it is, ``labels`` hold its onboarding label as a bit, ``earlier`` the
    first opens before a first open, ``scroll`` the depth of a scroll on any platform. An event without
    parameters is no activity to the overview, but counts for the other reports.
    """
    event, android = F.col("event_name"), F.coalesce(F.col("platform") == v.ANDROID, F.lit(False))
    rows = events.where((F.col("platform") == v.ANDROID) | (event == v.SCROLL)).withColumn("screen_name", param_string(v.SCREEN_NAME))
    screen = F.col("screen_name")
    active = F.size("event_params.key") > 0
    opened, custom = event == v.FIRST_OPEN, event.isin(list(v.CUSTOM_EVENTS))
    kind = classify.install_type(param_int(v.PREVIOUS_FIRST_OPEN_COUNT))
    met = {
        ON_ANDROID: F.lit(True),
        ACTIVE: active,
        OPENED: active & opened,
        CUSTOM: active & custom,
        FRESH: opened & (kind == v.FRESH_INSTALL),
        REINSTALLED: opened & (kind == v.REINSTALL),
        STEPPED: custom & screen.isin(list(v.ONBOARDING_SCREENS)),
    }
    flags = sum((F.when(condition, bit).otherwise(0) for bit, condition in met.items()), F.lit(0).cast("bigint"))
    number = (
        F.when(event.isNull(), LABELS.index(v.NO_CUSTOM_EVENT) + 1)
        .when(screen.isNull(), LABELS.index(v.NO_EVENT) + 1)
        .otherwise(rule_number(v.ONBOARDING_RULES, event, screen))
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("label_number") - 1).cast("int"))
    # a repeated key counts with its greatest value here, as in the exploded parameters
    every = f"array_max(transform(filter(event_params, p -> p.key = '{v.PREVIOUS_FIRST_OPEN_COUNT}'), p -> p.value.int_value))"
    none = F.lit(0).cast("bigint")
    return rows.withColumn("label_number", number).select(
        *KEYS,
        *extracts.dimensions(),
        F.when(android, flags).otherwise(none).alias("flags"),
        F.when(android & (F.col("label_number") > 0), bit).otherwise(none).alias("labels"),
        F.when(android & opened, F.expr(every)).alias("earlier"),
        F.when(event == v.SCROLL, F.coalesce(param_int(v.PERCENT_SCROLLED), none)).alias("scroll"),
    )


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Marks merged by keys."""
    return rows.groupBy(*keys).agg(
        F.bit_or("flags").alias("flags"), F.bit_or("labels").alias("labels"), F.max("earlier").alias("earlier"), F.max("scroll").alias("scroll")
    )


def user_day_state(events: DataFrame) -> DataFrame:
    """Marks merged by day, user, version and place: all that the reports need, whatever they filter by."""
    return merged(marks(events), *KEYS, *extracts.DIMENSIONS)


@dataclass(frozen=True)
class JourneyFilters:
    """What each report is asked for. A range of the overview needs both its ends."""

    overview: FilterSpec = NO_FILTERS
    new_users: FilterSpec = NO_FILTERS
    all_users: FilterSpec = NO_FILTERS

    def ranges(self) -> list[FilterSpec]:
        whole = self.overview if self.overview.start and self.overview.end else NO_FILTERS
        return [FilterSpec(start=s.start, end=s.end) for s in (whole, self.new_users, self.all_users)]


def _between(rows: DataFrame, ranges: Iterable[FilterSpec]) -> DataFrame:
    """The days that some report wants, as one range, so that it prunes folders."""
    starts, ends = [s.start for s in ranges], [s.end for s in ranges]
    if None not in starts:
        rows = rows.where(F.col("event_date") >= compact_day(min(starts)))
    if None not in ends:
        rows = rows.where(F.col("event_date") <= compact_day(max(ends)))
    return rows


def _has(column: str, bits: int) -> Column:
    return F.coalesce(F.col(column).bitwiseAND(F.lit(bits).cast("bigint")) != 0, F.lit(False))


def user_days(rows: DataFrame, filters: JourneyFilters = JourneyFilters()) -> DataFrame:
    """One row per (day, user) with what each report sees of it, from marks or stored state; one shuffle."""
    filters.overview.only()
    filters.new_users.only("install_type", *VERSIONS, *PLACES)
    filters.all_users.only(*VERSIONS, *PLACES)
    names = {name: name for name in extracts.DIMENSIONS}
    ranges = filters.ranges()
    in_overview, in_new, _ = (meets(s, "event_date", {}) for s in ranges)
    in_steps, in_all = (meets(s, "event_date", names) for s in (filters.new_users, filters.all_users))

    def merged_where(condition: Column, mark: str) -> Column:
        return F.bit_or(F.when(condition, F.col(mark)))

    return (
        _between(rows, ranges)
        .groupBy(*KEYS)
        .agg(
            merged_where(in_overview, "flags").alias("overview_flags"),
            F.max(F.when(in_overview, F.col("earlier"))).alias("earlier"),
            merged_where(in_new, "flags").alias("install_flags"),
            merged_where(in_steps, "flags").alias("step_flags"),
            merged_where(in_steps, "labels").alias("step_labels"),
            merged_where(in_all, "flags").alias("all_flags"),
            merged_where(in_all, "labels").alias("all_labels"),
        )
    )


def daily_journeys(rows: DataFrame, filters: JourneyFilters = JourneyFilters()) -> DataFrame:
    """One row per ``event_date`` with the counts of each report as a struct, NULL where the report lacks the day.

    ``rows`` are :func:`marks` of events or stored state. Store or persist the result, which has one
    row a day, and take each report from it with :func:`report_of`.
    """
    known = F.col("user_pseudo_id").isNotNull()
    active = _has("overview_flags", ACTIVE)
    kind = classify.user_type(_has("overview_flags", OPENED).cast("int"), F.col("earlier"))
    overview = {
        "total_users": active,
        "new_users": active & (kind != v.RETURNING_USER),
        "returning_users": active & (kind == v.RETURNING_USER),
        "fresh_installs": active & (kind == v.FRESH_INSTALL),
        "reinstalls": active & (kind == v.REINSTALL),
        "users_with_custom_event": _has("overview_flags", CUSTOM),
    }

    spec = filters.new_users
    kinds = sum(INSTALLS.get(name, 0) for name in set(spec.install_type)) if spec.install_type else FRESH | REINSTALLED
    matched = _has("step_flags", STEPPED) & known
    installed = _has("install_flags", kinds)
    if spec.selected(extracts.DIMENSIONS):
        installed = installed & matched
    new = {"total_users": installed}
    new |= {v.snake(label): installed & matched & _has("step_labels", 1 << i) for i, label in enumerate(v.ONBOARDING_LABELS)}
    new[v.snake(v.NO_CUSTOM_EVENT)] = installed & ~matched

    there = _has("all_flags", ON_ANDROID)
    every = {"total_users": there} | {v.snake(label): there & _has("all_labels", 1 << i) for i, label in enumerate(LABELS)}

    conditions = dict(zip(REPORTS, (overview, new, every), strict=True))
    counted = user_days(rows, filters).groupBy("event_date").agg(
        *(F.max(c["total_users"]).alias(f"{name}_there") for name, c in conditions.items()),
        *(F.count_if(condition & known).alias(f"{name}_{column}") for name, c in conditions.items() for column, condition in c.items()),
    )
    structs = (
        F.when(F.col(f"{name}_there"), F.struct(*(F.col(f"{name}_{column}").alias(column) for column in c))).alias(name)
        for name, c in conditions.items()
    )
    return counted.select("event_date", *structs)


def report_of(daily: DataFrame, name: str, missing: reports.Missing = "zero") -> DataFrame:
    """One report of :func:`daily_journeys`, as ``footfall.plans.reports`` gives it."""
    days = daily.where(F.col(name).isNotNull()).select("event_date", f"{name}.*")
    columns = [c for c in days.columns if c not in ("event_date", "total_users")]
    if name == "overview":
        return reports.newest_first(days, parse_day(F.col("event_date")), {c: F.col(c) for c in ("total_users", *columns)})
    return reports.funnel(days, columns, "null" if name == "new_user_onboarding" else "zero", missing)


def deepest_scroll(rows: DataFrame, booked_on: Column) -> DataFrame:
    """Deepest scroll per (``Dates``, ``User_ID``), as ``operators.scroll.max_scroll``, from marks or stored state."""
    scrolled = rows.where(F.col("scroll").isNotNull()).select(
        F.coalesce(parse_day(F.col("event_date")), booked_on).alias("Dates"), F.col("user_pseudo_id").alias("User_ID"), "scroll"
    )
    return scrolled.groupBy("Dates", "User_ID").agg(F.max("scroll").alias("max_scroll_percent"))


def scroll_depth(
    rows: DataFrame,
    web: DataFrame,
    new_user: DataFrame,
    filters: FilterSpec = NO_FILTERS,
    report_date: dt.date | None = None,
) -> DataFrame:
    """``reports.scroll_depth`` from marks or stored state in place of events."""
    booked_on = report_day(report_date)
    deepest = deepest_scroll(reports.scrolls_in_range(rows, filters, booked_on), booked_on)
    return reports.scroll_depth_of(deepest, web, new_user, filters, booked_on)
