"""Display names and number formats of the reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions.numbers import show_count, show_percent

Format = Callable[[Column], Column]


def as_is(column: Column) -> Column:
    return column


def plain_count(column: Column) -> Column:
    return show_count(column, thousands=False)


@dataclass(frozen=True)
class Shown:
    """Display name and format of one report column."""

    title: str
    fmt: Format


def _shares(labels) -> dict[str, Shown]:
    return {v.snake(label): Shown(label, show_percent) for label in labels}


def _funnel(labels) -> dict[str, Shown]:
    return {"dates": Shown("Dates", as_is), "total_users": Shown("Total Users", plain_count)} | _shares(labels)


# Column titles.
DISPLAY: dict[str, dict[str, Shown]] = {
    "overview": {
        "dates": Shown("event_date", as_is),
        "total_users": Shown("total_users", show_count),
        "new_users": Shown("new_users", show_count),
        "returning_users": Shown("returning_users", show_count),
        "fresh_installs": Shown("fresh_installs", show_count),
        "reinstalls": Shown("reinstalls", show_count),
        "users_with_custom_event": Shown("users_with_custom_event", show_count),
    },
    "new_user_onboarding": _funnel((*v.ONBOARDING_LABELS, v.NO_CUSTOM_EVENT)),
    "total_user_onboarding": _funnel((*v.ONBOARDING_LABELS, v.NO_EVENT, v.NO_CUSTOM_EVENT)),
    "explore_journey": _funnel((*v.EXPLORE_LABELS, *v.WATCH_LABELS)),
    "scroll_depth": {
        "dates": Shown("Dates", as_is),
        "total_users": Shown("Total Users", show_count),
        "interacted_users": Shown("Interacted Users", show_count),
        "bounce_pct": Shown("Bounce%", show_percent),
        "scrolled_20_pct": Shown("≥20%", show_percent),
        "scrolled_40_pct": Shown("≥40%", show_percent),
        "scrolled_60_pct": Shown("≥60%", show_percent),
        "scrolled_80_pct": Shown("≥80%", show_percent),
        "scrolled_100_pct": Shown("100%", show_percent),
    },
    "web_events": {"dates": Shown("Dates", as_is)}
    | {v.snake(label): Shown(label, show_count) for label in v.WEB_EVENTS},
    "goal_categories": {"total_users": Shown("Total Users", show_count)}
    | _shares((*v.GOAL_CATEGORIES, v.OTHERS)),
    "goal_sources": {
        "total_logged_in_users": Shown("Total Logged-in Users", show_count),
        "users_who_set_goals": Shown("Users Who Set Goals", show_count),
    }
    | {v.snake(group): Shown(f"{group} %", show_percent) for group in sorted(v.SOURCE_GROUPS)},
}


def format_report(report: DataFrame, name: str) -> DataFrame:
    """Every number as display text; column names stay."""
    shown = DISPLAY[name]
    return report.select(*(shown[c].fmt(F.col(c)).alias(c) for c in report.columns))


def with_titles(report: DataFrame, name: str) -> DataFrame:
    """Column names replaced with display titles; columns the report lacks are ignored."""
    return report.withColumnsRenamed({c: shown.title for c, shown in DISPLAY[name].items()})
