"""Long reports turned wide, where they leave Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from footfall.sinks.csv import write_csv

COUNTS = ("total_users", "total_logged_in_users", "users_who_set_goals")


def turned_wide(long: DataFrame, always: Sequence[str] = (), counts: Sequence[str] = COUNTS) -> DataFrame:
    """One row per key with a column per label of a long report, in the order of ``position``.

    Runs the report, once: its rows, one per day and label at most, come to the driver and nothing stays
    stored. ``always`` names columns that an empty report has as well; ``counts`` are whole numbers.
    """
    keys = [f for f in long.schema if f.name not in ("position", "column", "value")]
    names = [f.name for f in keys]
    rows: dict[tuple, dict[str, float]] = {}
    places = {column: (-1, i) for i, column in enumerate(always)}
    for row in long.collect():
        rows.setdefault(tuple(row[name] for name in names), {})[row["column"]] = row["value"]
        places[row["column"]] = (row["position"], 0)
    columns = sorted(places, key=places.get)
    whole = {c for c in columns if c in counts}
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys]
    types += [f"`{c}` {'bigint' if c in whole else 'double'}" for c in columns]
    values = [
        (*key, *(int(x) if c in whole and x is not None else x for c in columns for x in [row.get(c)])) for key, row in rows.items()
    ]
    return long.sparkSession.createDataFrame(values, ", ".join(types))


def write_present_csv(long: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """Writes a long report as one wide CSV file with display titles in the folder ``path``."""
    write_csv(turned_wide(long), name, path, mode)
