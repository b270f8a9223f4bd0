"""Visits and first-seen users that are stored by user."""

import pytest
from pyspark.sql import functions as F

from catalog import adapter
from footfall.plans.extracts import web_rows
from footfall.sources import by_user
from tests.conftest import TESTDATA
from tests.rows import first_seen, visit, web

BUCKETS = 8


@pytest.fixture
def stored(spark, tmp_path):
    made = []

    def store(visits, seen, name):
        tables = f"{name}_visits", f"{name}_seen"
        by_user.store_visits(visits, tables[0], BUCKETS, str(tmp_path / tables[0]))
        by_user.store_first_seen(seen, tables[1], BUCKETS, str(tmp_path / tables[1]))
        made.extend(tables)
        return tables

    yield store
    for table in made:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@pytest.fixture
def nothing_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def counted(frame):
    columns = [c for c in frame.columns if c != "n_rows"]
    return {tuple(r[:-1]): r[-1] for r in frame.groupBy(*columns).agg(F.sum("n_rows")).collect()}


def test_the_join_shuffles_neither_side(spark, stored, nothing_broadcast):
    t = adapter.tables(spark, f"{TESTDATA}/sf0.001")
    rows = by_user.stored_web_rows(spark, *stored(t.web_user_data, t.new_user, "plan"))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("SortMergeJoin") == 1 and text.count("Bucketed: true") == 2
    assert counted(rows) == counted(web_rows(t.web_user_data, t.new_user))


def test_odd_rows_and_hot_users(spark, stored):
    visits = [visit("2024-01-01", user="hot")] * 500 + [visit(f"2024-01-0{d}", user="hot", device=f"d{d}") for d in range(1, 9)]
    visits += [visit("2024-01-02", user=None)] * 300 + [visit("2024-01-02", user=None, city=f"c{i}") for i in range(40)]
    visits += [visit(None, user="new"), visit("2024-01-05", "other", user="new"), visit("2024-01-05", user="")]
    seen = [("hot", "2024-01-01"), ("hot", "2024-01-01"), ("hot", "2024-01-03"), ("new", None), (None, "2024-01-02"), ("", "2024-01-05")]
    visits, seen = web(spark, *visits), first_seen(spark, *seen)
    tables = stored(visits, seen, "odd")
    assert counted(by_user.stored_web_rows(spark, *tables)) == counted(web_rows(visits, seen))
    assert spark.table(tables[0]).where("User_ID = 'hot'").count() == 9  # copies are one row with their number
    keys = spark.table(tables[0]).where("User_ID IS NULL").select("match_key").distinct().count()
    assert keys > 10  # rows without a user do not meet in one bucket


def test_empty_tables(spark, stored):
    tables = stored(web(spark), first_seen(spark), "empty")
    assert by_user.stored_web_rows(spark, *tables).count() == 0


def test_one_file_per_bucket(spark, stored, tmp_path):
    t = adapter.tables(spark, f"{TESTDATA}/sf0.001")
    stored(t.web_user_data, t.new_user, "files")
    assert len(list((tmp_path / "files_seen").glob("*.parquet"))) <= BUCKETS
