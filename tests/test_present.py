"""Reports with the labels that occur, and what a run says about an empty one."""

import csv
import datetime as dt
import glob

import pytest

import footfall as ff
from footfall import vocabulary as v
from footfall.operators.guard import NO_KNOWN_SOURCES, NO_ROWS
from footfall.plans import reports as r
from tests.rows import dicts, event, events

DAY_MS = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def explored(user, screen="home_screen", name="screen_load", day=1):
    props = {v.USER_ID: user, v.FIRST_OPEN_TIME: DAY_MS + (day - 1) * 86_400_000}
    return event(name, user=user, day=f"2024010{day}", params={v.SCREEN_NAME: screen}, props=props)


def goal(user, text, screen=v.GOAL_SCREEN, **params):
    return event("view_click", user=user, params={v.USER_ID: user, v.SCREEN_NAME: screen, v.GOAL_SELECTED: text, **params})


@pytest.fixture(scope="module")
def explore(spark):
    return events(spark, explored("a"), explored("b", "beesi_kya_hai"), explored("b"), explored("c", "beesi_kya_hai", "play_player", day=2))


@pytest.fixture(scope="module")
def goals(spark):
    rows = [goal("1", "Car", source="set_now_home_screen"), goal("2", "Bike"), goal("3", "a bike"), goal("4", "Zoo", source="elsewhere"), goal("5", None)]
    return ff.goal_rows(events(spark, *rows))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_long_reports_are_lazy_and_read_once(spark, explore, goals):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for frame in (ff.explore_journey_long(explore), ff.goal_categories_long(goals), ff.goal_sources_long(goals)):
        assert plan(frame).count("LocalTableScan") + plan(frame).count("Scan ExistingRDD") == 1
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_explore_in_long_form(explore):
    rows = [tuple(row) for row in ff.explore_journey_long(explore).collect()]
    first, watch, last = r.explore_columns()
    shown = ["total_users", "user_landed_on_homepage", "user_land_on_beesi_kya_hai_screen", "user_click_on_play_button_on_beesi_kya_hai_screen", *watch]
    assert [c for day, _, c, _ in rows if day == "2024-01-02"] == shown == [c for day, _, c, _ in rows if day == "2024-01-01"]
    assert [day for day, *_ in rows] == sorted((day for day, *_ in rows), reverse=True)
    values = {(day, c): x for day, _, c, x in rows}
    assert values["2024-01-01", "total_users"] == 2 and values["2024-01-01", "user_land_on_beesi_kya_hai_screen"] == 50
    assert values["2024-01-02", "user_landed_on_homepage"] == 0  # somebody did it on another day


def test_long_reports_turn_wide_as_the_wide_ones(explore, goals):
    for long, wide in (
        (ff.explore_journey_long(explore), ff.explore_journey(explore)),
        (ff.goal_categories_long(goals), ff.goal_categories(goals, missing="omit")),
        (ff.goal_sources_long(goals), ff.goal_sources(goals, missing="omit")),
    ):
        turned = ff.turned_wide(long)
        assert turned.columns == wide.columns and dicts(turned) == dicts(wide)
        assert dict(turned.dtypes)[next(c for c in turned.columns if c.startswith("total"))] == "bigint"
    full = ff.explore_journey(explore, missing="zero").collect()
    assert [{c: row[c] for c in wide_row} for row, wide_row in zip(full, dicts(ff.explore_journey(explore)), strict=True)] == dicts(ff.explore_journey(explore))


def test_goals_by_falling_share_and_sources_in_order(goals):
    assert [tuple(x) for x in ff.goal_categories_long(goals).collect()] == [(1, "total_users", 4.0), (2, "bike", 50.0), (3, "car", 25.0), (4, "others", 25.0)]
    assert [tuple(x) for x in ff.goal_sources_long(goals).collect()] == [(1, "total_logged_in_users", 5.0), (2, "users_who_set_goals", 4.0), (3, "home_screen", 25.0)]


def test_empty_reports_in_long_form(spark, goals):
    nothing = ff.FilterSpec(country=["nowhere"])
    assert ff.explore_journey_long(events(spark)).count() == ff.goal_categories_long(goals, nothing).count() == ff.goal_sources_long(goals, nothing).count() == 0
    assert ff.explore_journey(events(spark)).columns == ["dates", "total_users", *map(v.snake, v.WATCH_LABELS)]
    assert ff.goal_sources(goals, nothing, missing="omit").columns == ["total_logged_in_users", "users_who_set_goals"]


def test_wide_csv_of_a_long_report(goals, tmp_path):
    ff.write_present_csv(ff.goal_categories_long(goals), "goal_categories", str(tmp_path / "g"))
    with open(glob.glob(f"{tmp_path}/g/*.csv")[0], newline="") as handle:
        assert list(csv.reader(handle)) == [["Total Users", "Bike", "Car", "Others"], ["4", "50.0", "25.0", "25.0"]]


def test_nothing_stays_persisted(spark, explore, goals):
    ff.explore_journey(explore), ff.total_user_onboarding(explore, missing="omit"), ff.goal_categories(goals, missing="omit")
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


# --- empty reports --------------------------------------------------------------


def run(goals, *specs):
    both, check = ff.checked_goal_reports(goals, *specs)
    row = both.first()
    return row, check.counts(), check.warnings()


def test_counts_are_known_after_one_run(goals):
    row, counts, warnings = run(goals)
    assert counts == {"extract": 5, "goals": 5, "goal_clicks": 4, "sources": 5, "known_sources": 1} and warnings == {}
    assert row["goals"] == ff.goal_categories(goals).first() and row["sources"] == ff.goal_sources(goals).first()


def test_warnings_of_empty_reports(spark, goals):
    nowhere = ff.FilterSpec(country=["nowhere"])
    row, counts, warnings = run(goals, nowhere, nowhere)
    assert (row["goals"], row["sources"], counts["extract"], counts["goals"]) == (None, None, 5, 0)
    assert warnings == {"goals": NO_ROWS, "sources": NO_ROWS}
    row, counts, warnings = run(goals, ff.FilterSpec(), nowhere)
    assert row["goals"]["total_users"] == 4 and warnings == {"sources": NO_ROWS}
    row, counts, warnings = run(ff.goal_rows(events(spark, goal("1", "Car", screen="x"), goal("2", None, source="elsewhere"))))
    assert counts["sources"] == 2 and warnings == {"goals": NO_ROWS, "sources": NO_KNOWN_SOURCES}
    row, counts, warnings = run(ff.goal_rows(events(spark)))
    assert set(counts.values()) == {0} and warnings == {"goals": NO_ROWS, "sources": NO_ROWS}


def test_checked_reports_read_once(spark, goals, tmp_path):
    goals.write.parquet(str(tmp_path / "rows"))
    both, _ = ff.checked_goal_reports(spark.read.parquet(str(tmp_path / "rows")), ff.FilterSpec(country=["IN"]))
    text = plan(both)
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
