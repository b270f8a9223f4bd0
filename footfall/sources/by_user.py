"""Web visits and first-seen users stored by user, so that matching them shuffles neither."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions.dates import report_day
from footfall.operators.first_seen import as_user_types, counted_matches, first_days, with_match_key
from footfall.plans.extracts import on_web_events

VISIT_COLUMNS = ("Dates", "Event_Name", "Device", "Country", "Region", "City", "User_ID")
KEY = "match_key"


def _store(rows: DataFrame, table: str, buckets: int, path: str | None) -> None:
    """One sorted file per bucket: rows are dealt to as many tasks as there are buckets, by the bucket's own hash."""
    writer = rows.repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def store_first_seen(new_user: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Stores one row per first-seen user with the days, bucketed and sorted by user."""
    _store(first_days(new_user), table, buckets, path)


def store_visits(web: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Stores the listed web events, bucketed and sorted by user, equal rows as one with their number ``n_rows``.

    Counting before the shuffle keeps a user with most of the visits down to a row per day, event, device
    and place; rows without a user are spread over keys that match nobody.
    """
    counted = on_web_events(web).groupBy(*VISIT_COLUMNS).agg(F.count("*").alias("n_rows"))
    _store(with_match_key(counted, "User_ID"), table, buckets, path)


def stored_web_rows(
    spark: SparkSession, visits: str, first_seen: str, report_date: dt.date | None = None
) -> DataFrame:
    """``extracts.web_rows`` from the two stored tables.

    Both are read bucket by bucket in the order of users, so the join needs no shuffle on
    either side; ``buckets`` must be the same for both.
    """
    joined = spark.table(visits).join(spark.table(first_seen), KEY, "left")
    typed = as_user_types(counted_matches(joined, "Dates").drop(KEY), copies=F.col("n_rows"))
    unknown = {c: F.coalesce(c, F.lit(v.UNKNOWN)) for c in ("Device", "Country", "Region", "City")}
    return typed.withColumns({"Dates": F.coalesce("Dates", report_day(report_date)), **unknown})
