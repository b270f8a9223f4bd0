"""Reports in long form, (position, column, value), with the columns somebody appears in and no others.

Which columns a table has must be known before it runs, but which labels occur is known only after.
In long form that is a condition on rows, so a report stays one lazy plan; the sinks turn it wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.text import text_array


def _unpivoted(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    numbers = wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    return numbers.unpivot(list(keys), list(columns), "column", "value")


def _of(columns: Sequence[str]) -> Column:
    return F.col("column").isin(list(columns))


def daily_long(daily: DataFrame, day: str, columns: Sequence[str], always: Sequence[str]) -> DataFrame:
    """(day, position, column, value) of the ``always`` columns and of those above 0 on some day.

    ``position`` is the place in ``columns``. The window sees one row per day of a column.
    """
    seen = F.max(F.col("value") > 0).over(Window.partitionBy("column"))
    position = F.array_position(text_array(columns), F.col("column"))
    long = _unpivoted(daily, [day], columns).withColumns({"seen": _of(always) | F.coalesce(seen, F.lit(False)), "position": position})
    return long.where("seen").select(day, "position", "column", "value").orderBy(F.desc(day), "position")


def row_long(wide: DataFrame, columns: Sequence[str], always: Sequence[str], by_value: bool = False) -> DataFrame:
    """(position, column, value) of a one-row report without its NULLs; ``by_value`` puts the greatest first after ``always``.

    Ordered over one row per column.
    """
    given = F.array_position(text_array(columns), F.col("column"))
    order = [F.desc("first"), F.desc("value"), "column"] if by_value else ["given"]
    long = _unpivoted(wide, [], columns).where("value IS NOT NULL").withColumns({"given": given, "first": F.when(_of(always), -given)})
    ranked = long.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return ranked.select("position", "column", "value").orderBy("position")
