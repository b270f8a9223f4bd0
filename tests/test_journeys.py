"""Several reports from one scan, and from state that is kept by day."""

import datetime as dt
import glob
import itertools
import os
import re

import pytest
from pyspark.sql import functions as F

import footfall as ff
from catalog import adapter
from footfall import vocabulary as v
from footfall.operators.scroll import max_scroll
from footfall.plans import journeys as j
from footfall.functions.dates import report_day
from footfall.sources import state
from tests.conftest import TESTDATA
from tests.rows import dicts, event, events, first_seen, visit, web

COUNT, SCREEN = "previous_first_open_count", "screen_name"
SINGLE = {"overview": ff.overview, "new_user_onboarding": ff.new_user_onboarding, "total_user_onboarding": ff.total_user_onboarding}
RANGE = {"start": dt.date(2024, 1, 2), "end": dt.date(2024, 1, 3)}


@pytest.fixture(scope="module")
def odd_events(spark):
    """Rows that the single reports treat each in its own way."""
    load = {SCREEN: "splash_screen"}
    rows = [
        event("first_open", "a", params={COUNT: 0}, country="IN", version="1"),
        event("first_open", "a", params={COUNT: 2}),
        event("first_open", "b", params=[(COUNT, 0), (COUNT, 4)], country="US"),
        event("first_open", "c"),
        event("first_open", "c2", params=None),
        event("first_open", "d", params={"other": 1}),
        event("screen_load", "a", params=load, country="IN", version="1"),
        event("screen_load", "a", params=load, country="US", version="2"),
        event("view_click", "b", params=load, country="US"),
        event("view_click", "b", params={SCREEN: "home_screen"}, country="IN"),
        event("screen_load", "e", params={SCREEN: "elsewhere"}),
        event("screen_load", "f"),
        event(None, "g", params=load),
        event("session_start", "h", params={"k": 1}),
        event("session_start", None, params=load),
        event("first_open", None, params={COUNT: 1}),
        event("screen_load", "a", platform="IOS", params=load),
        event("first_open", "i", platform=None, params={COUNT: 0}),
        event("Scroll", "a", params={"percent_scrolled": 40}),
        event("Scroll", "a", platform="WEB", params={"percent_scrolled": 90}, country="IN"),
        event("Scroll", "s", platform=None),
    ]
    more = [dict(r, event_date=day) for r, day in zip(rows, itertools.cycle(("20240102", "20240103", "20240104")), strict=False)]
    alone = [event("Scroll", "x", day="20240106", platform="WEB"), event("session_start", None, day="20240107", params={"k": 1}), event("session_start", "y", day=None)]
    return events(spark, *rows, *more, *alone)


SPECS = [
    j.JourneyFilters(),
    j.JourneyFilters(ff.FilterSpec(**RANGE), ff.FilterSpec(install_type=[v.REINSTALL]), ff.FilterSpec(country=["IN"])),
    j.JourneyFilters(ff.FilterSpec(start=RANGE["start"]), ff.FilterSpec(country=["US"], **RANGE), ff.FilterSpec(end=RANGE["end"])),
    j.JourneyFilters(ff.FilterSpec(**RANGE), ff.FilterSpec(app_version=["1"], install_type=[v.FRESH_INSTALL], **RANGE), ff.FilterSpec(app_version=["nothing"], **RANGE)),
    j.JourneyFilters(all_users=ff.FilterSpec(country=["IN", "US"]), new_users=ff.FilterSpec(install_type=["nothing"])),
]


@pytest.mark.parametrize("filters", SPECS)
@pytest.mark.parametrize("stored", [False, True])
def test_one_pass_equals_the_single_reports(odd_events, filters, stored):
    rows = j.user_day_state(odd_events) if stored else j.marks(odd_events)
    daily = j.daily_journeys(rows, filters)
    specs = (filters.overview, filters.new_users, filters.all_users)
    for (name, single), spec in zip(SINGLE.items(), specs, strict=True):
        assert dicts(j.report_of(daily, name)) == dicts(single(odd_events, spec)), name


def test_deepest_scroll_equals_the_operator(odd_events):
    wanted = sorted(map(str, dicts(max_scroll(odd_events, report_day(dt.date(2024, 2, 1))))))
    for rows in (j.marks(odd_events), j.user_day_state(odd_events)):
        assert sorted(map(str, dicts(j.deepest_scroll(rows, report_day(dt.date(2024, 2, 1)))))) == wanted and len(wanted) > 3


def test_missing_labels_and_no_rows(spark, odd_events):
    daily = j.daily_journeys(j.marks(odd_events))
    assert dicts(j.report_of(daily, "total_user_onboarding", "null")) == dicts(ff.total_user_onboarding(odd_events, missing="null"))
    nothing = j.daily_journeys(j.marks(events(spark)))
    assert all(j.report_of(nothing, name).count() == 0 for name in j.REPORTS)


def test_strange_filters_are_refused(odd_events):
    for filters in (j.JourneyFilters(overview=ff.FilterSpec(country=["IN"])), j.JourneyFilters(all_users=ff.FilterSpec(install_type=["x"]))):
        with pytest.raises(ValueError, match="no filter for"):
            j.daily_journeys(j.marks(odd_events), filters)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("journeys"))
    adapter.write_tables(adapter.tables(spark, f"{TESTDATA}/sf0.001"), path)
    return path


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_one_scan_and_one_shuffle_by_user(spark, folders):
    rows = j.marks(ff.scan_events(spark, f"{folders}/events"))
    for filters in SPECS:
        text = plan(j.daily_journeys(rows, filters))
        assert text.count("FileScan") == 1 and "Join" not in text and "Python" not in text
        assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+(?:, (\w+)#\d+)?", text) == [("event_date", ""), ("event_date", "user_pseudo_id")]
        assert "Or(EqualTo(platform,ANDROID),EqualTo(event_name,Scroll))" in text


def test_the_range_of_all_reports_prunes_folders(spark, folders):
    spec = ff.FilterSpec(**RANGE)
    text = plan(j.daily_journeys(j.marks(ff.scan_events(spark, f"{folders}/events")), j.JourneyFilters(spec, ff.FilterSpec(start=RANGE["end"], end=dt.date(2024, 1, 9)), spec)))
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text).group(1)
    assert "20240102" in pruned and "20240109" in pruned


# --- kept state ---------------------------------------------------------------


@pytest.fixture
def kept(spark, odd_events, tmp_path):
    prefix, path = f"{tmp_path}/events_", f"{tmp_path}/state"

    def shard(day, rows):
        rows.where(F.col("event_date") == day).coalesce(1).write.mode("overwrite").parquet(f"{prefix}{day}")

    for day in ("20240101", "20240102", "20240103"):
        shard(day, odd_events)
    return prefix, path, shard


def same_as_events(spark, kept, filters):
    prefix, path, _ = kept
    given = ff.scan_event_shards(spark, prefix)
    daily = j.daily_journeys(state.scan_state(spark, path), filters)
    specs = (filters.overview, filters.new_users, filters.all_users)
    return all(dicts(j.report_of(daily, name)) == dicts(single(given, spec)) for (name, single), spec in zip(SINGLE.items(), specs, strict=True))


def files_of(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/event_date=*/*.parquet")}


def test_state_follows_replaced_added_and_removed_shards(spark, odd_events, kept):
    prefix, path, shard = kept
    assert state.scan_state(spark, path).count() == 0
    assert state.bring_up_to_date(spark, prefix, path) == ["20240101", "20240102", "20240103"]
    assert same_as_events(spark, kept, SPECS[1])
    before = files_of(path)
    assert state.bring_up_to_date(spark, prefix, path) == [] and files_of(path) == before

    shard("20240102", odd_events.where("event_name <> 'first_open'"))  # a late shard replaces its day
    shard("20240104", odd_events)  # and one comes
    assert state.bring_up_to_date(spark, prefix, path) == ["20240102", "20240104"]
    after = files_of(path)
    assert {p: t for p, t in before.items() if "20240102" not in p} == {p: t for p, t in after.items() if not re.search("20240102|20240104", p)}
    assert all(same_as_events(spark, kept, filters) for filters in SPECS[:3])

    shard("20240101", odd_events.where("false"))  # a day without events any more
    os.rename(f"{prefix}20240103", f"{os.path.dirname(path)}/away")  # and a shard that went
    assert state.bring_up_to_date(spark, prefix, path) == ["20240101", "20240103"]
    assert {r["event_date"] for r in state.scan_state(spark, path).collect()} == {"20240102", "20240104"}
    assert same_as_events(spark, kept, SPECS[0])
    assert state.bring_up_to_date(spark, prefix, path) == []


def test_only_days_of_the_range_are_brought_up_to_date(spark, kept):
    prefix, path, _ = kept
    day = dt.date(2024, 1, 2)
    assert state.bring_up_to_date(spark, prefix, path, day, day) == ["20240102"]
    assert list(state.days_behind(spark, prefix, path)) == ["20240101", "20240103"]
    assert {r["event_date"] for r in state.scan_state(spark, path, day).collect()} == {"20240102"}


def test_state_is_one_row_per_user_day_version_and_place(spark, odd_events):
    found = j.user_day_state(odd_events.unionByName(odd_events)).where("user_pseudo_id = 'a' AND event_date = '20240101'")
    assert found.count() == 4  # without place or version, in IN with and without one, in US
    assert found.columns == [c.split(" ")[0] for c in ("event_date", "user_pseudo_id")] + [f.split(" ")[0] for f in state.STATE.split(", ")[1:-2]]


def test_scroll_report_from_state(spark, kept):
    prefix, path, _ = kept
    state.bring_up_to_date(spark, prefix, path)
    visits = web(spark, *(visit(f"2024-01-0{d}", user=u) for d in (1, 2, 3) for u in ("a", "s", "w")))
    seen = first_seen(spark, ("a", "2024-01-01"), ("s", "2024-01-02"))
    for spec in (ff.FilterSpec(), ff.FilterSpec(start=dt.date(2024, 1, 2), user_type=[v.WEB_NEW_USER])):
        wanted = dicts(ff.scroll_depth(ff.scan_event_shards(spark, prefix), visits, seen, spec))
        assert dicts(j.scroll_depth(state.scan_state(spark, path), visits, seen, spec)) == wanted and wanted
