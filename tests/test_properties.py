"""Relations that hold in every report, whatever the data."""

import pytest

import __spark_entry__ as entry_points
from footfall import vocabulary as v
from tests.conftest import TESTDATA
from tests.rows import dicts

QUERIES = entry_points.queries()


@pytest.fixture(params=["sf0.001", "sf0.01"])
def rows_of(request, spark):
    return lambda name: dicts(QUERIES[name](spark, f"{TESTDATA}/{request.param}"))


def test_overview_splits_users(rows_of):
    for row in rows_of("report_overview"):
        assert row["total_users"] == row["new_users"] + row["returning_users"]
        assert row["fresh_installs"] + row["reinstalls"] <= row["new_users"]


def test_onboarding_shares_are_shares(rows_of):
    for name in ("report_new_user", "report_total_user"):
        for row in rows_of(name):
            assert all(0 <= share <= 100 for c, share in row.items() if c not in ("dates", "total_users"))


def test_watch_buckets_add_up(rows_of):
    for row in rows_of("report_explore"):
        assert sum(row[v.snake(label)] for label in v.WATCH_LABELS) == pytest.approx(100)


def test_deeper_scrolls_are_fewer(rows_of):
    for row in rows_of("report_scroll"):
        shares = [row[f"scrolled_{t}_pct"] or 0 for t in v.SCROLL_THRESHOLDS]
        assert shares == sorted(shares, reverse=True)
        assert row["bounce_pct"] + row["interacted_users"] / row["total_users"] * 100 == pytest.approx(100, abs=0.01)


def test_goal_shares_add_up(rows_of):
    for row in rows_of("report_goals"):
        assert sum(x or 0 for c, x in row.items() if c != "total_users") == pytest.approx(100, abs=0.2)
