"""User-day state kept by day: reports read it instead of all events, and only days whose events changed are computed again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.filters import between_event_days
from footfall.plans import extracts
from footfall.plans.journeys import user_day_state
from footfall.sources.shared import read_if_there
from footfall.sources.tables import scan_event_days

MARKS = ("flags", "labels", "earlier", "scroll")
#: ``version`` is filled in one row a day, which has no user and says which files the day was computed from.
STATE = ", ".join(
    [
        "user_pseudo_id string",
        *(f"{name} string" for name in extracts.DIMENSIONS),
        *(f"{name} bigint" for name in MARKS),
        "version bigint",
        "event_date string",
    ]
)
GONE = 0  # the version of a day without files


def shard_versions(spark: SparkSession, prefix: str) -> DataFrame:
    """(event_date, version) per day folder or file ``<prefix>yyyyMMdd``; only names, sizes and times are read.

    A version changes when a file of the day comes, goes or is written anew.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{prefix}*").select("path", "modificationTime", "length")
    name = prefix.rstrip("/").rsplit("/", 1)[-1]
    day = F.regexp_extract("path", f"/\\Q{name}\\E([0-9]{{8}})(?:[/.]|$)", 1)
    data = ~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")
    return (
        files.where(data & (day != ""))
        .groupBy(day.alias("event_date"))
        .agg(F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("version"))
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    found = read_if_there(spark, path, STATE)
    return spark.createDataFrame([], STATE) if found is None else found


def days_behind(
    spark: SparkSession, prefix: str, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> dict[str, int]:
    """The days whose files are not those that the state was computed from, with their versions; at most one a calendar day."""
    stored = _stored(spark, path).where("version IS NOT NULL").select("event_date", F.col("version").alias("known"))
    versions = shard_versions(spark, prefix).join(stored, "event_date", "full")
    gone = F.lit(GONE).cast("bigint")
    behind = versions.where(~F.coalesce("version", gone).eqNullSafe(F.col("known")))
    rows = between_event_days(behind, "event_date", start, end).select("event_date", F.coalesce("version", gone).alias("version"))
    return {row["event_date"]: row["version"] for row in rows.orderBy("event_date").collect()}


def write_state(events: DataFrame, path: str, versions: dict[str, int]) -> None:
    """Replaces the state of exactly the days of ``versions`` by that of their events; other days stay as they are.

    Dynamic partition overwrite: tasks write beside the table and the folders of the days are exchanged
    when all have ended, so a lost executor leaves the old days. Every day gets its version row, so a day
    whose events all went is replaced as well. The rebalance keeps files few and splits a day with most of the
    rows. Events without a day belong to no shard and to no state.
    """
    spark = events.sparkSession
    rows = user_day_state(events.where(F.col("event_date").isin(list(versions)))).withColumn("version", F.lit(None).cast("bigint"))
    days = spark.createDataFrame(list(versions.items()), "event_date string, version bigint")
    empty = {name: F.lit(0).cast("bigint") for name in ("flags", "labels")}
    marked = days.select(*(F.col(f.name) if f.name in days.columns else empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema))
    (
        rows.unionByName(marked)
        .hint("rebalance", "event_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def bring_up_to_date(
    spark: SparkSession, prefix: str, path: str, start: dt.date | None = None, end: dt.date | None = None, fmt: str = "parquet"
) -> list[str]:
    """Computes the days that are behind from their own shards alone, and lists them.

    Versions are read before the events, so a shard that changes meanwhile is met again the next time.
    """
    behind = days_behind(spark, prefix, path, start, end)
    if behind:
        there: Sequence[str] = [day for day, version in behind.items() if version != GONE]
        write_state(scan_event_days(spark, prefix, there, fmt), path, behind)
    return list(behind)


def scan_state(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The stored rows as :func:`footfall.plans.journeys.marks` gives them for events; a day range prunes folders."""
    rows = between_event_days(_stored(spark, path), "event_date", start, end)
    return rows.where("version IS NULL").drop("version")

