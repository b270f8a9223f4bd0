"""What the filters of each report can offer: its day bounds and the values of its dimensions, from one pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions.dates import format_day, parse_day, report_day
from footfall.operators.filters import PERSON, PLACES, VERSIONS, on_android
from footfall.operators.first_seen import as_user_types
from footfall.plans import extracts
from footfall.plans.reports import WEB_COLUMNS
from footfall.sources.tables import Tables

FIRST_DAY, LAST_DAY = "first_day", "last_day"
EVENT_DAY, WEB_DAY = "event_date", "Dates"


def _same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


@dataclass(frozen=True)
class Offered:
    """Where a report's options come from: its row-level extract, the columns of its dimensions, and its day.

    ``known_only`` also leaves out the spellings of unknown values, in any case.
    """

    extract: Callable[[Tables, dt.date | None], DataFrame]
    dimensions: Mapping[str, str]
    day: str = EVENT_DAY
    known_only: bool = False

    def day_text(self) -> Column:
        return format_day(parse_day(F.col(self.day)) if self.day == EVENT_DAY else F.col(self.day))


def _active_rows(tables: Tables, _: dt.date | None) -> DataFrame:
    return on_android(tables.events).where(F.size("event_params.key") > 0)


def _new_user_rows(tables: Tables, _: dt.date | None) -> DataFrame:
    return extracts.new_user_rows(tables.events)


def _total_user_rows(tables: Tables, _: dt.date | None) -> DataFrame:
    return extracts.total_user_rows(tables.events)


def _explore_rows(tables: Tables, _: dt.date | None) -> DataFrame:
    return extracts.explore_rows(tables.events)


def _goal_rows(tables: Tables, _: dt.date | None) -> DataFrame:
    return extracts.goal_rows(tables.events)


def _web_rows(tables: Tables, report_date: dt.date | None) -> DataFrame:
    return extracts.web_rows(tables.web_user_data, tables.new_user, report_date)


def _scroll_rows(tables: Tables, report_date: dt.date | None) -> DataFrame:
    # the depth of a scroll is no option, so the events are left alone
    visits = extracts.user_days_of(extracts.on_web_events(tables.web_user_data))
    typed = as_user_types(extracts.with_first_seen(visits, tables.new_user))
    return typed.withColumn(WEB_DAY, F.coalesce(WEB_DAY, report_day(report_date)))


OFFERED: dict[str, Offered] = {
    "overview": Offered(_active_rows, {}),
    "new_user_onboarding": Offered(_new_user_rows, _same("install_type", *VERSIONS, *PLACES)),
    "total_user_onboarding": Offered(_total_user_rows, _same(*VERSIONS, *PLACES)),
    "explore_journey": Offered(_explore_rows, _same(*VERSIONS, *PLACES, *PERSON)),
    "scroll_depth": Offered(_scroll_rows, {"user_type": "User_Type"}, WEB_DAY, known_only=True),
    "web_events": Offered(_web_rows, WEB_COLUMNS | {"user_type": "User_Type"}, WEB_DAY, known_only=True),
    "goal_categories": Offered(_goal_rows, _same(*VERSIONS, *PLACES, *PERSON)),
    "goal_sources": Offered(_goal_rows, _same(*VERSIONS, *PLACES, *PERSON)),
}


def report_options(name: str, tables: Tables, report_date: dt.date | None = None) -> DataFrame:
    """(dimension, option) of one report, sorted; ``first_day`` and ``last_day`` are its bounds as ``yyyy-MM-dd``.

    Dimensions are named as in ``FilterSpec``. NULL and '' are no options. The extract is read once: each
    row gives a pair for each dimension and one for its day, equal pairs meet before the shuffle,
    and days shrink to their least and greatest in the same aggregate. Without rows there are no options.
    """
    offered = OFFERED[name]
    rows = offered.extract(tables, report_date).withColumn("option_day", offered.day_text())
    none = F.lit(None).cast("string")
    pairs = [F.struct(F.lit(None).cast("string").alias("dimension"), none.alias("option"), F.col("option_day").alias("day"))]
    for dimension, column in offered.dimensions.items():
        value = F.nullif(F.col(column), F.lit(""))
        if offered.known_only:
            value = F.when(~F.lower(value).isin(list(v.UNKNOWN_OPTIONS)), value)
        pairs.append(F.struct(F.lit(dimension).alias("dimension"), value.alias("option"), none.alias("day")))
    met = rows.select(F.inline(F.array(*pairs))).where("option IS NOT NULL OR day IS NOT NULL")
    grouped = met.groupBy("dimension", "option").agg(F.min("day").alias("first"), F.max("day").alias("last"))

    def entry(dimension: Column, option: str) -> Column:
        return F.struct(dimension.alias("dimension"), F.col(option).alias("option"))

    bounds = F.array(entry(F.lit(FIRST_DAY), "first"), entry(F.lit(LAST_DAY), "last"))
    listed = F.when(F.col("dimension").isNull(), bounds).otherwise(F.array(entry(F.col("dimension"), "option")))
    return grouped.select(F.inline(listed)).orderBy("dimension", "option")
