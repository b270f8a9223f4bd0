"""Classes of users, goals, sources and watch times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions.rules import rule_label, rule_number
from footfall.functions.text import text_array


def user_type(had_first_open: Column, previous_count: Column) -> Column:
    """Class of a user-day. A first open without a count is a plain new user."""
    return (
        F.when(had_first_open != 1, v.RETURNING_USER)
        .when(previous_count == 0, v.FRESH_INSTALL)
        .when(previous_count > 0, v.REINSTALL)
        .otherwise(v.NEW_USER)
    )


def install_type(previous_count: Column) -> Column:
    """Class of one first-open event. Here a missing count means a fresh install."""
    return F.when(previous_count > 0, v.REINSTALL).otherwise(v.FRESH_INSTALL)


def _other(event: Column, screen: Column) -> Column:
    # concat is NULL when a part is, and callers rely on that
    return F.concat(F.lit(v.OTHER_PREFIX), event, F.lit(" - "), screen)


def onboarding_label(event: Column, screen: Column) -> Column:
    """Onboarding label; 'No custom event' without an event, 'Other: ...' off the list."""
    return F.coalesce(
        rule_label(v.ONBOARDING_RULES, event, screen),
        F.when(event.isNull(), v.NO_CUSTOM_EVENT).otherwise(_other(event, screen)),
    )


def explore_number(event: Column, screen: Column, view: Column) -> Column:
    """One-based number of the explore action, 0 when it is not on the list."""
    return rule_number(v.EXPLORE_RULES, event, screen, view)


def label_of(number: Column, labels: Sequence[str]) -> Column:
    """Label by one-based number, NULL for 0."""
    return F.get(text_array(labels), (number - 1).cast("int"))


def goal_category(
    is_custom: Column, goal: Column, categories: Sequence[str] = v.GOAL_CATEGORIES
) -> Column:
    """First category whose name occurs in the goal, in any case; custom goals are Others."""
    text = F.lower(goal)
    found = F.coalesce(*(F.when(F.contains(text, F.lit(name.lower())), name) for name in categories), F.lit(v.OTHERS))
    return F.when(F.coalesce(is_custom == 1, F.lit(False)), v.OTHERS).otherwise(found)


def source_category(source: Column, groups: Mapping[str, Sequence[str]] = v.SOURCE_GROUPS) -> Column:
    """Group of an entry source, NULL when it belongs to none."""
    return F.coalesce(*(F.when(source.isin(list(members)), group) for group, members in groups.items()))


def watch_bucket(seconds: Column) -> Column:
    """Watch bucket of a user's longest view of the day; NULL for negative seconds."""
    bucket = F.when(seconds == 0, v.NOT_WATCHED)
    for label, above, at_most in v.WATCH_BUCKETS:
        inside = seconds > above if at_most is None else (seconds > above) & (seconds <= at_most)
        bucket = bucket.when(inside, label)
    return bucket
