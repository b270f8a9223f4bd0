"""The three input tables and SQL over them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from footfall import schema
from footfall.functions.dates import compact_day
from footfall.operators.filters import between_event_days


def _scan(spark: SparkSession, paths: tuple[str, ...], declared: str, fmt: str) -> DataFrame:
    # one read per path, since every path may have day folders of its own
    reads = [spark.read.format(fmt).schema(declared).load(path) for path in paths]
    return reduce(DataFrame.unionByName, reads)


def scan_events(
    spark: SparkSession,
    *paths: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """The nested event table over one or more paths.

    Laid out by ``event_date=yyyyMMdd`` folders, a day range prunes folders.
    """
    events = _scan(spark, paths, schema.EVENTS, fmt)
    return between_event_days(events, "event_date", start, end)


def scan_event_shards(
    spark: SparkSession,
    prefix: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """The nested event table kept as one folder or file per day, ``<prefix>yyyyMMdd``, in one read.

    A range with both ends chooses the shards by name, and those that do not exist
    are passed over; with one end or none all are read. The days of the rows
    are held to the range either way.
    """
    if start and end:
        chosen = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
        events = scan_event_days(spark, prefix, [compact_day(day) for day in chosen], fmt)
    else:
        events = spark.read.format(fmt).schema(schema.EVENTS).load(f"{prefix}*")
    return between_event_days(events, "event_date", start, end)


def scan_event_days(spark: SparkSession, prefix: str, days: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The shards ``<prefix>yyyyMMdd`` of the given days in one read; those that do not exist are passed over."""
    if not days:
        return spark.createDataFrame([], schema.EVENTS)
    return spark.read.format(fmt).schema(schema.EVENTS).load(f"{prefix}{{{','.join(days)}}}")


def scan_web(spark: SparkSession, *paths: str, fmt: str = "parquet") -> DataFrame:
    """The flat web-activity table."""
    return _scan(spark, paths, schema.WEB, fmt)


def scan_new_user(spark: SparkSession, *paths: str, fmt: str = "parquet") -> DataFrame:
    """The first-seen table: users and their first days."""
    return _scan(spark, paths, schema.NEW_USER, fmt)


@dataclass(frozen=True)
class Tables:
    """The input tables of all reports."""

    events: DataFrame
    web_user_data: DataFrame
    new_user: DataFrame

    def register(self) -> Tables:
        """Makes the tables known to SQL under their field names."""
        self.events.createOrReplaceTempView("events")
        self.web_user_data.createOrReplaceTempView("web_user_data")
        self.new_user.createOrReplaceTempView("new_user")
        return self


def run_sql(tables: Tables, text: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """A SQL text as a lazy DataFrame; ``{events}`` and the like stand for the tables, ``:name`` for a value of ``args``.

    Values are bound as literals after the text is parsed, so nothing in them is read as SQL: a
    text may hold quotes, braces or colons, a date stays a date, None is NULL. Leaves no views
    behind. For plain names call ``register`` and use ``spark.sql``.
    """
    session = tables.events.sparkSession
    given = {field.name: getattr(tables, field.name) for field in fields(tables)}
    used = {name: table for name, table in given.items() if f"{{{name}}}" in text}
    return session.sql(text, args=dict(args) if args else None, **used)


def share_extract(extract: DataFrame) -> DataFrame:
    """Keeps an extract that several reports read; the caller unpersists it.

    Blocks lost with an executor are computed again from the source.
    """
    return extract.persist(StorageLevel.MEMORY_AND_DISK)
