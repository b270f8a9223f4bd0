"""Goal and entry-source shares of logged-in users."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions.classify import goal_category, source_category
from footfall.functions.numbers import percent, round2
from footfall.operators.guard import EmptyCheck
from footfall.operators.user_days import has_label, label_number, user_days


def is_goal_click() -> Column:
    return (
        (F.col("event_name") == v.VIEW_CLICK)
        & (F.col("screen_name") == v.GOAL_SCREEN)
        & F.col("goal_selected").isNotNull()
    )


def is_known_source(groups: Iterable[str]) -> Column:
    return source_category(F.col("sources")).isin(list(groups))


def goal_clicks(rows: DataFrame) -> DataFrame:
    """Clicks that chose a goal on the goal screen."""
    return rows.where(is_goal_click())


def latest_goal(clicks: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The goal of each user's latest day.

    Within a day the largest ``tiebreak`` columns win, then the larger goal
    text, so that the choice never depends on row order. A maximum is combined
    before the shuffle, so a user with many clicks sends one row per task.
    """
    chosen = F.max(F.struct("event_date", *tiebreak, "goal_selected", "goal_category")).alias("chosen")
    return (
        clicks.withColumn("goal_category", goal_category(F.col("is_custom_goal"), F.col("goal_selected")))
        .groupBy("user_id")
        .agg(chosen)
        .select("user_id", "chosen.event_date", "chosen.goal_selected", "chosen.goal_category")
    )


def goal_shares(latest: DataFrame) -> DataFrame:
    """Users and share per goal category, most frequent first, one row each."""
    counts = latest.groupBy("goal_category").agg(F.count("*").alias("users"))
    total = F.sum("users").over(Window.partitionBy())  # over one row per category
    return counts.withColumn("pct", round2(percent(F.col("users"), total))).orderBy(
        F.desc("users"), "goal_category"
    )


def goals_wide(latest: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """One row: all users and the share of each category, NULL for absent ones.

    ``categories`` maps category to column name. No users, no row.
    """
    counted = latest.agg(
        F.count("*").alias("total_users"),
        *(F.count_if(F.col("goal_category") == c).alias(name) for c, name in categories.items()),
    )
    shares = (
        round2(percent(F.nullif(F.col(name), F.lit(0)), F.col("total_users"))).alias(name)
        for name in categories.values()
    )
    return counted.where("total_users > 0").select("total_users", *shares)


def other_goals(latest: DataFrame) -> DataFrame:
    """Distinct goal texts that ended up in Others."""
    return latest.where(F.col("goal_category") == v.OTHERS).select("goal_selected").distinct()


def _source_users(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    number = label_number(source_category(F.col("sources")), groups)
    return user_days(
        rows, ["user_id"], number, len(groups), has_goal=F.max(F.col("goal_selected").isNotNull())
    )


def source_counts(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row: all users, users with a goal and distinct users per source group.

    ``names`` maps group to column name.
    """
    users = _source_users(rows, list(names))
    known = F.col("user_id").isNotNull()
    return users.agg(
        F.count_if(known).alias("total_logged_in_users"),
        F.count_if(known & F.col("has_goal")).alias("users_who_set_goals"),
        *(F.count_if(known & has_label(i)).alias(name) for i, name in enumerate(names.values())),
    )


def source_shares(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row: both totals and each group's share of the users with a goal.

    The users of a group need not have set a goal, so a share can pass 100.
    Absent groups are NULL. Without any known source there is no row.
    """
    any_source = F.greatest(*names.values()) > 0
    shares = (
        round2(percent(F.nullif(F.col(name), F.lit(0)), F.col("users_who_set_goals"))).alias(name)
        for name in names.values()
    )
    return (
        source_counts(rows, names)
        .where(any_source)
        .select("total_logged_in_users", "users_who_set_goals", *shares)
    )


def goals_and_sources(
    rows: DataFrame,
    in_goals: Column,
    in_sources: Column,
    categories: Mapping[str, str],
    groups: Mapping[str, str],
    tiebreak: Sequence[str] = (),
    check: EmptyCheck | None = None,
) -> DataFrame:
    """One row of two structs: what ``goals_wide`` and ``source_shares`` give for the rows of each condition.

    Rows are reduced once, to one per user with the latest goal of the one set and the
    source bits of the other. A struct is NULL where its report has no row. A ``check`` counts
    rows in the same reduction, so rows that neither report wants are read as well.
    """
    category = goal_category(F.col("is_custom_goal"), F.col("goal_selected")).alias("goal_category")
    choice = F.struct("event_date", *tiebreak, "goal_selected", category)
    users = user_days(
        rows.where(in_goals | in_sources) if check is None else rows,
        ["user_id"],
        F.when(in_sources, label_number(source_category(F.col("sources")), list(groups))),
        len(groups),
        latest=F.max(F.when(in_goals & is_goal_click(), choice)),
        logged_in=F.max(in_sources),
        has_goal=F.max(in_sources & F.col("goal_selected").isNotNull()),
        **({} if check is None else check.partial()),
    )
    known = F.col("user_id").isNotNull()
    counted = users.agg(
        F.count_if(F.col("latest").isNotNull()).alias("total_users"),
        F.count_if(known & F.col("logged_in")).alias("total_logged_in_users"),
        F.count_if(known & F.col("has_goal")).alias("users_who_set_goals"),
        *(F.count_if(F.col("latest.goal_category") == c).alias(f"goal_{name}") for c, name in categories.items()),
        *(F.count_if(known & has_label(i)).alias(f"source_{name}") for i, name in enumerate(groups.values())),
        *([] if check is None else check.totals()),
    )
    if check is not None:
        counted = check.observed(counted)

    def share(column: str, total: str) -> Column:
        return round2(percent(F.nullif(F.col(column), F.lit(0)), F.col(total)))

    goals = (share(f"goal_{name}", "total_users").alias(name) for name in categories.values())
    sources = (share(f"source_{name}", "users_who_set_goals").alias(name) for name in groups.values())
    any_source = F.greatest(*(f"source_{name}" for name in groups.values())) > 0
    return counted.select(
        F.when(F.col("total_users") > 0, F.struct("total_users", *goals)).alias("goals"),
        F.when(any_source, F.struct("total_logged_in_users", "users_who_set_goals", *sources)).alias("sources"),
    )
