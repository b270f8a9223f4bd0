"""Results stay exact when one user, day or missing user holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from catalog import adapter
from catalog.oracle import oracle_sql
from catalog.queries import BUILDERS
from tests.compare import differences
from tests.conftest import TESTDATA

ORACLE = oracle_sql()
JOINED = ["join_newuser_events", "join_first_seen", "join_scroll", "distinct_rows", "web_user_type", "latest_goal"]
CHECKED = sorted(name for name in BUILDERS if name.startswith("report_")) + JOINED


@pytest.fixture(scope="module")
def hot(spark):
    raw = spark.read.parquet(f"{TESTDATA}/sf0.01/events.parquet")
    third = F.col("event_id") % 3 == 0
    day = F.expr("TIMESTAMP_NTZ'2024-01-04 12:00:00.5'")
    hot_rows = raw.withColumn("user_id", F.when(third, F.lit(7)).otherwise(F.col("user_id"))).withColumn(
        "ts", F.when(F.col("event_id") % 5 == 0, day).otherwise(F.col("ts"))
    )
    return adapter.tables_of(hot_rows)


@pytest.fixture(scope="module")
def hot_duck(duck):
    connection = duck("sf0.01")
    connection.execute(
        f"""CREATE OR REPLACE VIEW events AS SELECT * REPLACE (
            CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
            CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-01-04 12:00:00.5' ELSE ts END AS ts
        ) FROM '{TESTDATA}/sf0.01/events.parquet'"""
    )
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_hot_user_and_day(hot, hot_duck, name):
    assert differences(BUILDERS[name](hot), hot_duck.execute(ORACLE[name])) == ""


@pytest.mark.parametrize("name", CHECKED)
def test_repeated_rows(spark, hot, hot_duck, name):
    """Copies of every row change no report, and only the row counts of extracts."""
    twice = adapter.Tables(*(t.unionAll(t) for t in (hot.events, hot.web_user_data, hot.new_user)))
    frame = BUILDERS[name](twice)
    text = ORACLE[name]
    if "n_rows" in frame.columns:
        frame = frame.drop("n_rows")
        text = f"SELECT * EXCLUDE (n_rows) FROM ({text})"
    assert differences(frame, hot_duck.execute(text)) == ""
