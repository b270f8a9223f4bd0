"""Scans, SQL, shared extracts, display and CSV."""

import csv
import datetime as dt
import glob

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import footfall as ff
from footfall.sinks.display import DISPLAY
from tests.rows import dicts, event, events, first_seen, visit, web


@pytest.fixture
def small(spark):
    load = {"screen_name": "splash_screen"}
    rows = [event("screen_load", user=u, day=d, params=load) for u, d in (("a", "20240101"), ("b", "20240102"), ("c", "20240103"))]
    return ff.Tables(events(spark, *rows), web(spark, visit("2024-01-01")), first_seen(spark, ("w", "2024-01-01")))


def test_scan_reads_day_folders_of_several_paths(spark, small, tmp_path):
    wider = small.events.withColumn("event_timestamp", F.lit(1))
    for name, day in (("one", "20240101"), ("two", "20240102")):
        wider.where(F.col("event_date") == day).write.partitionBy("event_date").parquet(str(tmp_path / name))
    scanned = ff.scan_events(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert "event_timestamp" not in scanned.columns
    assert dict(scanned.dtypes)["event_date"] == "string"
    assert sorted(row["user_pseudo_id"] for row in scanned.collect()) == ["a", "b"]
    ranged = ff.scan_events(spark, str(tmp_path / "one"), str(tmp_path / "two"), start=dt.date(2024, 1, 2))
    assert [row["user_pseudo_id"] for row in ranged.collect()] == ["b"]


def test_scan_of_shards_takes_those_of_the_range_that_exist(spark, small, tmp_path):
    for day in ("20240101", "20240103"):
        small.events.where(F.col("event_date") == day).write.parquet(str(tmp_path / f"events_{day}"))
    prefix = str(tmp_path / "events_")

    def users(*days):
        return sorted(row["user_pseudo_id"] for row in ff.scan_event_shards(spark, prefix, *days).collect())

    assert users() == ["a", "c"]
    assert users(dt.date(2024, 1, 2), dt.date(2024, 1, 4)) == ["c"]
    assert users(dt.date(2024, 1, 2)) == ["c"]
    assert users(dt.date(2024, 1, 4), dt.date(2024, 1, 2)) == []


def test_scan_of_other_formats(spark, small, tmp_path):
    small.web_user_data.write.json(str(tmp_path / "web"))
    small.new_user.write.orc(str(tmp_path / "nu"))
    assert dicts(ff.scan_web(spark, str(tmp_path / "web"), fmt="json")) == dicts(small.web_user_data)
    assert dicts(ff.scan_new_user(spark, str(tmp_path / "nu"), fmt="orc")) == dicts(small.new_user)


def test_sql_over_tables_and_views(spark, small):
    text = "SELECT count(*) AS n FROM {events} CROSS JOIN {new_user}"
    assert ff.run_sql(small, text).first()["n"] == 3
    small.register()
    assert spark.sql("SELECT count(*) AS n FROM web_user_data").first()["n"] == 1


def test_values_are_bound_and_never_parsed(spark, small):
    text = "SELECT count(*) AS n, min(:note) AS note, min(:none) AS none FROM {events} WHERE user_pseudo_id IN (:one, :two) AND to_date(event_date, 'yyyyMMdd') >= :since"
    args = {"note": "it's {events} :one -- \"x\" \\", "one": "a' OR '1'='1", "two": "b", "since": dt.date(2024, 1, 2), "none": None}
    assert dicts(ff.run_sql(small, text, args)) == [{"n": 1, "note": args["note"], "none": None}]
    assert ff.run_sql(small, "SELECT :x AS x", {"x": 3}).first()["x"] == 3
    with pytest.raises(AnalysisException):
        ff.run_sql(small, "SELECT :missing AS x FROM {events}", {"other": 1})


def test_shared_extract_serves_both_goal_reports(small):
    shared = ff.share_extract(ff.goal_rows(small.events))
    assert shared.storageLevel.useMemory and shared.storageLevel.useDisk
    assert ff.goal_categories(shared).count() == 0 and ff.goal_sources(shared).count() == 0
    shared.unpersist()
    assert not shared.storageLevel.useMemory


def reports(t):
    goals = ff.goal_rows(t.events)
    return {
        "overview": ff.overview(t.events),
        "new_user_onboarding": ff.new_user_onboarding(t.events),
        "total_user_onboarding": ff.total_user_onboarding(t.events),
        "explore_journey": ff.explore_journey(t.events, missing="zero"),
        "scroll_depth": ff.scroll_depth(t.events, t.web_user_data, t.new_user),
        "web_events": ff.web_events(t.web_user_data, t.new_user),
        "goal_categories": ff.goal_categories(goals),
        "goal_sources": ff.goal_sources(goals),
    }


def test_every_report_has_titles_and_formats(small):
    for name, report in reports(small).items():
        titled = ff.with_titles(report, name)
        assert titled.columns == [DISPLAY[name][c].title for c in report.columns], name
        assert {dtype for _, dtype in ff.format_report(report, name).dtypes} == {"string"}, name


def test_csv_is_one_ordered_file_with_titles(small, tmp_path):
    path = str(tmp_path / "report")
    ff.write_csv(ff.total_user_onboarding(small.events), "total_user_onboarding", path)
    files = glob.glob(f"{path}/*.csv")
    assert len(files) == 1
    with open(files[0], newline="") as handle:
        header, *lines = csv.reader(handle)
    assert header[:4] == ["Dates", "Total Users", "Splash", "Initial login screen"]
    assert [line[:4] for line in lines] == [[f"2024-01-0{d}", "1", "100.0", "0.0"] for d in (3, 2, 1)]


def test_csv_leaves_missing_values_empty_and_names_the_day(small, tmp_path):
    ff.write_csv(reports(small)["scroll_depth"], "scroll_depth", str(tmp_path / "s"))
    with open(glob.glob(f"{tmp_path}/s/*.csv")[0], newline="") as handle:
        header, line = csv.reader(handle)
    assert header == ["Dates", "Total Users", "Interacted Users", "Bounce%", "≥20%", "≥40%", "≥60%", "≥80%", "100%"]
    assert line == ["2024-01-01", "1", "0", "100.0", "", "", "", "", ""]
    ff.write_csv(reports(small)["overview"], "overview", str(tmp_path / "o"))
    with open(glob.glob(f"{tmp_path}/o/*.csv")[0], newline="") as handle:
        assert next(csv.reader(handle))[0] == "event_date"


def test_session_settings(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session = ff.build_session(shuffle_partitions=3, settings={"spark.sql.session.timeZone": "Asia/Kolkata"})
        assert session.conf.get("spark.sql.shuffle.partitions") == "3"
        assert session.conf.get("spark.sql.session.timeZone") == "Asia/Kolkata"
        assert session.conf.get("spark.sql.adaptive.enabled") == "true"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
