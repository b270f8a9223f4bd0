"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import differences
from tests.conftest import TESTDATA

QUERIES = entry_points.catalog_queries.queries()
ORACLE = entry_points.oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, f"{TESTDATA}/sf0.01"), duck("sf0.01").execute(ORACLE[name])) == ""


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("report_")))
def test_report_matches_sql_where_labels_are_absent(spark, duck, name):
    assert differences(QUERIES[name](spark, f"{TESTDATA}/sf0.001"), duck("sf0.001").execute(ORACLE[name])) == ""


def test_comparison_notices_a_difference(spark, duck):
    frame = QUERIES["report_overview"](spark, f"{TESTDATA}/sf0.001")
    assert differences(frame.limit(3), duck("sf0.001").execute(ORACLE["report_overview"]))
    renamed = frame.withColumnRenamed("new_users", "fresh")
    assert differences(renamed, duck("sf0.001").execute(ORACLE["report_overview"]))


def test_entry_returns_the_overview(spark):
    assert entry_points.entry(spark).columns[:2] == ["dates", "total_users"]


@pytest.mark.parametrize("name", ["report_overview", "report_total_user", "report_explore", "report_scroll", "report_web_events"])
def test_daily_reports_are_newest_first(spark, name):
    days = [row["dates"] for row in QUERIES[name](spark, f"{TESTDATA}/sf0.001").collect()]
    assert days == sorted(days, reverse=True) and len(set(days)) == len(days)


def test_round_half_even_meets_halves(spark, duck):
    sf = f"{TESTDATA}/sf0.01"
    plain = ORACLE["round_half_even"].replace("round_even(", "round(")
    assert differences(QUERIES["round_half_even"](spark, sf), duck("sf0.01").execute(plain)) != ""
