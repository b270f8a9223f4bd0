"""Product-journey analytics on event tables, as lazy Spark DataFrames."""

from footfall.operators.filters import FilterSpec
from footfall.plans.extracts import goal_rows
from footfall.plans.journeys import JourneyFilters, daily_journeys, marks, report_of, user_day_state
from footfall.plans.options import report_options
from footfall.plans.reports import (
    checked_goal_reports,
    custom_goals,
    explore_journey,
    explore_journey_long,
    goal_categories,
    goal_categories_long,
    goal_reports,
    goal_sources,
    goal_sources_long,
    new_user_onboarding,
    overview,
    scroll_depth,
    total_user_onboarding,
    web_events,
)
from footfall.session import build_session
from footfall.sinks.csv import write_csv
from footfall.sinks.display import format_report, with_titles
from footfall.sinks.wide import turned_wide, write_present_csv
from footfall.sources.snapshots import Snapshots
from footfall.sources.state import bring_up_to_date, scan_state
from footfall.sources.tables import (
    Tables,
    run_sql,
    scan_event_shards,
    scan_events,
    scan_new_user,
    scan_web,
    share_extract,
)

__all__ = [
    "FilterSpec",
    "JourneyFilters",
    "Snapshots",
    "Tables",
    "bring_up_to_date",
    "build_session",
    "checked_goal_reports",
    "custom_goals",
    "daily_journeys",
    "explore_journey",
    "explore_journey_long",
    "format_report",
    "goal_categories",
    "goal_categories_long",
    "goal_reports",
    "goal_rows",
    "goal_sources",
    "goal_sources_long",
    "marks",
    "new_user_onboarding",
    "overview",
    "report_of",
    "report_options",
    "run_sql",
    "scan_event_shards",
    "scan_events",
    "scan_new_user",
    "scan_state",
    "scan_web",
    "scroll_depth",
    "share_extract",
    "total_user_onboarding",
    "turned_wide",
    "user_day_state",
    "web_events",
    "with_titles",
    "write_csv",
    "write_present_csv",
]
