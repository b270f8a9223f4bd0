"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, dt.datetime):
        return value.date() if value.time() == dt.time() else value
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return int(value)
    return value


def as_counter(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark_frame, cursor):
    """Empty text when both hold the same rows under the same column names."""
    columns = [d[0] for d in cursor.description]
    if sorted(spark_frame.columns) != sorted(columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(columns)}"
    got = as_counter(spark_frame.columns, spark_frame.collect())
    wanted = as_counter(columns, cursor.fetchall())
    if got == wanted:
        return ""
    return f"only in Spark {list((got - wanted).items())[:3]}, only in SQL {list((wanted - got).items())[:3]}"
