"""Physical plans over Parquet: what is read, pushed down and shuffled."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import footfall as ff
from catalog import adapter
from catalog.queries import BUILDERS
from footfall import vocabulary as v
from footfall.operators.first_seen import first_days, with_first_seen
from footfall.plans import extracts as x
from tests.conftest import TESTDATA

RANGE = {"start": dt.date(2024, 1, 5), "end": dt.date(2024, 1, 9)}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    adapter.write_tables(adapter.tables(spark, f"{TESTDATA}/sf0.001"), f"{path}/t")
    return ff.Tables(
        ff.scan_events(spark, f"{path}/t/events"),
        ff.scan_web(spark, f"{path}/t/web_user_data"),
        ff.scan_new_user(spark, f"{path}/t/new_user"),
    )


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def count(text, node):
    return len(re.findall(rf"[+:]- {node}|^\s*{node}", text, flags=re.M))


def funnels(t, **range_):
    spec = ff.FilterSpec(**range_)
    return {
        "overview": ff.overview(t.events, spec),
        "new": ff.new_user_onboarding(t.events, spec),
        "total": ff.total_user_onboarding(t.events, spec),
        "explore": ff.explore_journey(t.events, spec, missing="zero"),
    }


def test_daily_reports_scan_once_and_never_join(stored):
    for name, frame in funnels(stored).items():
        text = plan(frame)
        assert text.count("FileScan") == 1, name
        assert "Join" not in text, name
        # by (day, user), by day, and the order of the days
        assert text.count("Exchange") == 3, name
        assert "PushedFilters: [IsNotNull(platform), EqualTo(platform,ANDROID)" in text, name


def test_day_range_prunes_folders(stored):
    for name, frame in funnels(stored, **RANGE).items():
        partition_filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(frame)).group(1)
        assert "20240105" in partition_filters and "20240109" in partition_filters, name
    scrolled = plan(ff.scroll_depth(stored.events, stored.web_user_data, stored.new_user, ff.FilterSpec(**RANGE)))
    assert "20240105" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[IsNotNull\(event_name\)", scrolled).group(1)


def test_keyed_arrays_are_read_by_field(stored):
    schema = re.search(r"ReadSchema: (\S+)", plan(ff.total_user_onboarding(stored.events))).group(1)
    assert "event_params" in schema and "string_value" in schema
    assert "int_value" not in schema and "user_properties" not in schema and "geo" not in schema
    schema = re.search(r"ReadSchema: (\S+)", plan(ff.overview(stored.events))).group(1)
    assert "int_value" in schema and "string_value" not in schema


def test_scroll_join_adds_no_shuffle(spark, stored):
    """The plan for tables too large to broadcast, without the pruning subquery."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        text = plan(ff.scroll_depth(stored.events, stored.web_user_data, stored.new_user))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # visits and depths by (day, user), then by day; the join finds both sides in place
    assert text.count("Exchange hashpartitioning") == 3 and text.count("SortMergeJoin") == 1
    assert "EqualTo(event_name,Scroll)" in text


def test_first_seen_table_is_read_only_for_user_types(stored):
    assert "new_user" not in plan(ff.web_events(stored.web_user_data, stored.new_user))
    spec = ff.FilterSpec(user_type=[v.WEB_NEW_USER], device=["mobile"])
    text = plan(ff.web_events(stored.web_user_data, stored.new_user, spec))
    assert "EqualTo(Device,mobile)" in text or "In(Device, [mobile])" in text


def test_goal_clicks_reach_the_scan(stored):
    assert "EqualTo(event_name,view_click)" in plan(ff.goal_categories(ff.goal_rows(stored.events)))


def test_both_goal_reports_take_one_pass(stored):
    text = plan(ff.goal_reports(ff.goal_rows(stored.events), ff.FilterSpec(country=["India"]), ff.FilterSpec(**RANGE)))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_both_goal_reports_equal_the_single_ones(stored):
    rows = ff.goal_rows(stored.events)
    place = rows.where("country IS NOT NULL").agg(F.min("country")).first()[0]
    specs = (ff.FilterSpec(), ff.FilterSpec(country=[place]), ff.FilterSpec(**RANGE), ff.FilterSpec(country=["nowhere"]))
    for goals, sources in zip(specs, specs[1:] + specs[:1], strict=True):
        both = ff.goal_reports(rows, goals, sources).first()
        assert both["goals"] == ff.goal_categories(rows, goals).first()
        assert both["sources"] == ff.goal_sources(rows, sources).first()


def test_joined_extracts_are_equi_joins(stored):
    for frame in (
        x.new_user_rows(stored.events),
        x.web_rows(stored.web_user_data, stored.new_user),
        x.scroll_rows(stored.events, stored.web_user_data, stored.new_user),
    ):
        assert "Cartesian" not in plan(frame) and "NestedLoop" not in plan(frame)


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_no_query_leaves_the_jvm_or_crosses(stored, spark, name):
    text = plan(BUILDERS[name](adapter.tables(spark, f"{TESTDATA}/sf0.001")))
    assert not re.search(r"Python|Cartesian|NestedLoop|Pandas", text)


@pytest.fixture
def nothing_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_new_users_are_met_where_their_days_lie(stored, nothing_broadcast):
    new = ff.FilterSpec(user_type=[v.WEB_NEW_USER])
    # visits, depths and first days by (day, user), then by day
    assert plan(ff.scroll_depth(stored.events, stored.web_user_data, stored.new_user, new)).count("Exchange hashpartitioning") == 4
    # visits and first days by (day, user), then by day
    assert plan(ff.web_events(stored.web_user_data, stored.new_user, new)).count("Exchange hashpartitioning") == 3


def test_first_seen_table_is_shuffled_twice_for_returning_users(stored, nothing_broadcast):
    assert plan(first_days(stored.new_user)).count("Exchange hashpartitioning") == 2
    rows = x.user_days_of(x.on_web_events(stored.web_user_data))
    # the visits by (day, user) and by key; the first days by (key, day) and by key
    assert plan(with_first_seen(rows, stored.new_user)).count("Exchange hashpartitioning") == 4


def test_shards_are_one_scan(spark, stored, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    one = stored.events.limit(1)
    for day in days:
        one.withColumn("event_date", F.lit(day.strftime("%Y%m%d"))).coalesce(1).write.parquet(f"{tmp_path}/events_{day:%Y%m%d}")
    every = ff.scan_event_shards(spark, f"{tmp_path}/events_")
    assert plan(every).count("FileScan") == 1 and every.count() == 30
    text = plan(ff.scan_event_shards(spark, f"{tmp_path}/events_", *RANGE.values()))
    assert text.count("FileScan") == 1 and "(5 paths)" in text
