"""Session settings the reports are tuned for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    app_name: str = "footfall",
    shuffle_partitions: int | None = None,
    settings: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session with ``SETTINGS``, then the given ones.

    ``shuffle_partitions`` is an upper bound: adaptive execution merges small
    partitions but never makes more, so choose it for the largest shuffle.
    """
    chosen = SETTINGS | dict(settings or {})
    if shuffle_partitions is not None:
        chosen["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app_name)
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
