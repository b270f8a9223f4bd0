"""Reports as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footfall.sinks.display import with_titles


def write_csv(report: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """Writes a report as one CSV file with display titles in the folder ``path``.

    A report is ordered and has at most one row per calendar day, so one file
    is enough; only the last stage, after all counting, runs in one task.
    """
    with_titles(report, name).coalesce(1).write.mode(mode).option("header", True).csv(path)
