"""Extracts that are kept for an hour."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import footfall as ff
from footfall.sources.snapshots import Snapshots, snapshot_key
from tests.rows import dicts, event, events

NOON = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
MINUTE = dt.timedelta(minutes=1)


def goal(user, text, **more):
    params = {"beesi_user_id": user, "screen_name": "set_goal_bottomsheet", "goal_selected": text, "source": "set_now_home_screen"}
    return event("view_click", user=user, params=params, **more)


@pytest.fixture
def kept(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "kept"))


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "events")

    def write(*rows):
        events(spark, *rows).write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)

    write(goal("1", "Car"), goal("2", "Bike"))
    return path, write


def extract(spark, path, **filters):
    rows = ff.goal_rows(ff.scan_events(spark, path))
    return rows.where(F.col("country") == filters["country"]) if filters else rows


def users(frame):
    return sorted(row["user_id"] for row in frame.collect())


def folders(kept):
    return sorted(os.listdir(f"{kept.folder}/rows")) if os.path.isdir(f"{kept.folder}/rows") else []


def test_the_second_report_reads_the_snapshot(spark, kept, source):
    path, write = source
    first = kept.read(extract(spark, path), {"events": path}, NOON)
    assert users(first) == ["1", "2"]
    write(goal("3", "Laptop"))
    second = kept.read(extract(spark, path), {"events": path}, NOON + 59 * MINUTE)
    assert users(second) == ["1", "2"] and kept.entries().count() == 1
    assert all("/kept/rows/" in file for file in second.inputFiles())
    assert ff.goal_sources(second).first()["total_logged_in_users"] == ff.goal_categories(second).first()["total_users"] == 2


def test_a_stale_one_is_rebuilt(spark, kept, source):
    path, write = source
    kept.read(extract(spark, path), {"events": path}, NOON)
    write(goal("3", "Laptop"))
    later = kept.read(extract(spark, path), {"events": path}, NOON + 60 * MINUTE)
    assert users(later) == ["3"] and kept.entries().count() == 2
    assert users(kept.read(extract(spark, path), {"events": path}, NOON + 90 * MINUTE)) == ["3"]
    old = [row["path"] for row in kept.outdated(NOON + 90 * MINUTE).collect()]
    assert len(old) == 1 and old[0] not in later.inputFiles()[0]
    assert kept.outdated(NOON + 200 * MINUTE).count() == 2


def test_half_written_ones_are_never_read(spark, kept, source):
    path, _ = source
    failing = extract(spark, path).withColumn("broken", F.when(F.col("user_id") == "2", F.raise_error(F.lit("lost"))))
    with pytest.raises(PySparkException):
        kept.read(failing, {"events": path}, NOON)
    key = snapshot_key(extract(spark, path), {"events": path})
    extract(spark, path).limit(1).write.parquet(f"{kept.folder}/rows/{key}/cut-off")  # rows without an entry
    assert kept.entries().count() == 0
    assert users(kept.read(extract(spark, path), {"events": path}, NOON)) == ["1", "2"]


def test_plans_and_settings_are_told_apart(spark, kept, source):
    path, _ = source
    one = extract(spark, path)
    keys = {
        snapshot_key(one, {"events": path}),
        snapshot_key(one, {"events": f"{path}2"}),
        snapshot_key(one, {"events": path, "filters": ff.FilterSpec(country=["IN"])}),
        snapshot_key(extract(spark, path, country="IN"), {"events": path}),
        snapshot_key(extract(spark, path, country="US"), {"events": path}),
        snapshot_key(one.drop("age"), {"events": path}),
    }
    assert len(keys) == 6
    assert snapshot_key(extract(spark, path), {"events": path, "b": 1}) == snapshot_key(one, {"b": 1, "events": path})
    kept.read(extract(spark, path, country="IN"), {"events": path}, NOON)
    assert users(kept.read(extract(spark, path), {"events": path}, NOON)) == ["1", "2"] and len(folders(kept)) == 2


def test_an_empty_extract_is_kept_too(spark, kept, source):
    path, write = source
    assert dicts(kept.read(extract(spark, path, country="none"), {"events": path}, NOON)) == []
    write(goal("3", "Car", country="none"))
    assert dicts(kept.read(extract(spark, path, country="none"), {"events": path}, NOON + MINUTE)) == []
