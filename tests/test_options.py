"""What a report's filters offer."""

import datetime as dt

import pytest

import footfall as ff
from catalog import adapter
from footfall.operators.filters import FilterSpec
from footfall.plans.options import OFFERED
from tests.conftest import TESTDATA
from tests.rows import event, events, first_seen, visit, web


@pytest.fixture(scope="module")
def tables(spark):
    load = {"screen_name": "splash_screen"}
    rows = [
        event("first_open", "a", day="20240102", params={"k": 1}, country="IN", version="9"),
        event("screen_load", "a", day="20240102", params=load, country="IN", city="", version="1"),
        event("screen_load", "b", day="20240109", params=load, country="US"),
        event("screen_load", "b", day="20240111", country="FR"),
        event("screen_load", "b", day=None, params=load, country="DE"),
        event("screen_load", "b", day="20240130", platform="IOS", params=load, country="ES"),
    ]
    visits = [visit("2024-01-03", user="w", device="mobile", country="NaN", region="None"), visit(None, user="x", city="C1"), visit("2024-01-01", "other", device="tv")]
    return ff.Tables(events(spark, *rows), web(spark, *visits), first_seen(spark, ("w", "2024-01-03")))


def offered(name, tables):
    found = {}
    for row in ff.report_options(name, tables, dt.date(2024, 2, 1)).collect():
        found.setdefault(row["dimension"], []).append(row["option"])
    return found


def test_app_options(tables):
    assert offered("total_user_onboarding", tables) == {"first_day": ["2024-01-02"], "last_day": ["2024-01-11"], "app_version": ["1", "9"], "country": ["DE", "FR", "IN", "US"]}
    # version and place belong to the steps of new users
    assert offered("new_user_onboarding", tables) == {"first_day": ["2024-01-02"], "last_day": ["2024-01-02"], "app_version": ["1"], "country": ["IN"], "install_type": ["fresh_install"]}
    assert offered("overview", tables) == {"first_day": ["2024-01-02"], "last_day": ["2024-01-09"]}  # events without parameters are no activity


def test_web_options_leave_unknown_ones_out(tables):
    assert offered("web_events", tables) == {
        "first_day": ["2024-01-03"],
        "last_day": ["2024-02-01"],
        "device": ["mobile"],
        "city": ["C1"],
        "user_type": ["New User", "Returning User"],
    }
    assert offered("scroll_depth", tables) == {"first_day": ["2024-01-03"], "last_day": ["2024-02-01"], "user_type": ["New User", "Returning User"]}


def test_no_rows_no_options(spark):
    nothing = ff.Tables(events(spark), web(spark), first_seen(spark))
    assert all(offered(name, nothing) == {} for name in OFFERED)


def test_dimensions_are_those_that_filters_take():
    fields = set(FilterSpec.__dataclass_fields__)
    assert all(set(o.dimensions) <= fields for o in OFFERED.values())


@pytest.mark.parametrize("name", ["overview", "total_user_onboarding", "explore_journey", "goal_sources"])
def test_options_and_bounds_come_from_one_scan(spark, name, tmp_path):
    adapter.write_tables(adapter.tables(spark, f"{TESTDATA}/sf0.001"), f"{tmp_path}/t")
    stored = ff.Tables(ff.scan_events(spark, f"{tmp_path}/t/events"), ff.scan_web(spark, f"{tmp_path}/t/web_user_data"), ff.scan_new_user(spark, f"{tmp_path}/t/new_user"))
    text = ff.report_options(name, stored)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and "Join" not in text
