"""Extracts stored for a while, so that reports and sessions share them instead of reading the events again."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.sources.shared import read_if_there, shared_folder

KEPT_FOR = dt.timedelta(hours=1)
ENTRIES = "path string, created timestamp, snapshot string"


def _settings_text(settings: Mapping[str, object]) -> str:
    plain = {name: asdict(value) if is_dataclass(value) else value for name, value in settings.items()}
    return json.dumps(plain, sort_keys=True, default=str)


def snapshot_key(extract: DataFrame, settings: Mapping[str, object]) -> str:
    """Names an extract by its plan and the settings it was asked for with.

    The plan tells columns, conditions and literals, but not where its tables lie: ``settings`` must
    name them, along with whatever else the rows depend on.
    """
    plan = extract._jdf.queryExecution().analyzed().canonicalized().toString()
    parts = (plan, extract.schema.json(), _settings_text(settings))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Snapshots:
    """Stored extracts in a folder that all executors share; each is read for ``kept_for`` after it was asked for.

    An extract is written to a folder of its own, and only when that has ended does a row of the table of
    entries name it. Readers go by entries, so a half-written extract is never read, a failed one is never named,
    and two sessions that store the same extract at once do no harm: the newest entry holds. Old folders
    are left in place, since a report may still read them; :meth:`outdated` lists them for removal.
    """

    spark: SparkSession
    folder: str | None = None
    kept_for: dt.timedelta = KEPT_FOR

    @property
    def _root(self) -> str:
        return (self.folder or f"{shared_folder(self.spark)}/snapshots").rstrip("/")

    def entries(self) -> DataFrame:
        """(path, created, snapshot), one row per stored extract; few and short."""
        found = read_if_there(self.spark, f"{self._root}/entries", ENTRIES)
        return self.spark.createDataFrame([], ENTRIES) if found is None else found

    def _newest(self, key: str, now: dt.datetime) -> str | None:
        fresh = (F.col("snapshot") == key) & (F.col("created") > F.lit(now - self.kept_for)) & (F.col("created") <= F.lit(now))
        row = self.entries().where(fresh).agg(F.max(F.struct("created", "path")).alias("newest")).first()
        return row["newest"] and row["newest"]["path"]

    def read(self, extract: DataFrame, settings: Mapping[str, object], now: dt.datetime | None = None) -> DataFrame:
        """The rows of ``extract``, from storage where they are not older than ``kept_for``; else stored anew.

        What is given back reads the stored files, so it shows one state of the events to all reports
        and a lost executor costs a read of its part alone. Age counts from before the events were read.
        """
        now = now or dt.datetime.now(dt.timezone.utc)
        key = snapshot_key(extract, settings)
        path = self._newest(key, now)
        if path is None:
            path = f"{self._root}/rows/{key}/{uuid.uuid4().hex}"
            extract.write.parquet(path)
            entry = self.spark.createDataFrame([(path, now, key)], ENTRIES)
            entry.coalesce(1).write.mode("append").partitionBy("snapshot").parquet(f"{self._root}/entries")
        return self.spark.read.schema(extract.schema).parquet(path)

    def outdated(self, now: dt.datetime | None = None) -> DataFrame:
        """Paths of extracts that no report is given any more: older than ``kept_for``, or met by a newer one."""
        now = now or dt.datetime.now(dt.timezone.utc)
        newest = self.entries().groupBy("snapshot").agg(F.max(F.struct("created", "path")).alias("newest"))
        held = newest.where(F.col("newest.created") > F.lit(now - self.kept_for)).select(F.col("newest.path").alias("path"))
        return self.entries().select("path").join(held, "path", "left_anti")
