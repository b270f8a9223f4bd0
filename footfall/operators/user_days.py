"""Distinct users per day and label.

Every funnel asks the same question many times over: how many distinct users
had label L on day D? Rows are first reduced to one per (day, user) that holds
the user's labels as bits. A row then *is* a distinct user, so counting is a
conditional count per day and needs no further shuffle by user, however many
labels there are. The reduction runs before the shuffle too, so a user or a
day with a large share of all rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.text import text_array

WORD = 62  # labels per bit column; longer lists take more columns


def _word(number: int) -> str:
    return f"label_bits_{number}"


def label_number(label: Column, labels: Sequence[str]) -> Column:
    """One-based place of a label in a list, 0 off the list, NULL for NULL."""
    return F.array_position(text_array(labels), label)


def user_days(
    rows: DataFrame,
    keys: Sequence[str],
    number: Column | None = None,
    n_labels: int = 0,
    **aggregates: Column,
) -> DataFrame:
    """One row per key, usually (day, user), with label bits and other aggregates.

    ``number`` is a row's label by one-based number, 0 for a label off the
    list. The bits are NULL where no row had a number.
    """
    if n_labels:
        # a column of its own, so that it is computed once and not once per use
        rows = rows.withColumn("label_number", number)
    bits = {}
    for word in range(-(-n_labels // WORD)):
        place = F.col("label_number") - (word * WORD + 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))
        elsewhere = F.when(place.isNotNull(), F.lit(0).cast("bigint"))
        bits[_word(word)] = F.bit_or(F.when(place.between(0, WORD - 1), bit).otherwise(elsewhere))
    named = [c.alias(name) for name, c in {**bits, **aggregates}.items()]
    return rows.groupBy(*keys).agg(*named) if named else rows.select(*keys).distinct()


def has_any_label() -> Column:
    """Whether a user-day had any labelled row, on or off the list."""
    return F.col(_word(0)).isNotNull()


def has_label(index: int) -> Column:
    """Whether a user-day has the label at a zero-based place in its list."""
    word, bit = divmod(index, WORD)
    return F.expr(f"{_word(word)} & {1 << bit}L <> 0")


def count_users(
    reduced: DataFrame,
    day: str,
    user: str,
    conditions: Mapping[str, Column],
    count_missing_user: bool = False,
) -> DataFrame:
    """One row per day with the number of users that meet each condition.

    ``reduced`` has one row per (day, user). A NULL user is not counted unless
    ``count_missing_user``, which counts all of them as one more user.
    """
    known = F.lit(True) if count_missing_user else F.col(user).isNotNull()
    return reduced.groupBy(day).agg(
        *(F.count_if(condition & known).alias(name) for name, condition in conditions.items())
    )


def pivot_users(
    rows: DataFrame,
    day: str,
    user: str,
    label: str,
    labels: Mapping[str, str] | Sequence[str],
    total: str | None = None,
    count_missing_user: bool = False,
) -> DataFrame:
    """Days by labels, filled with distinct users; 0 where there are none.

    ``labels`` lists the label values, or maps them to column names. ``total``
    names a column for the day's distinct users over all labels. Rows without a
    label count towards the total only, and a day without any label has no row.
    """
    names = dict(labels) if isinstance(labels, Mapping) else {name: name for name in labels}
    number = label_number(F.col(label), list(names))
    reduced = user_days(rows, [day, user], number, len(names))
    conditions = {total: F.lit(True)} if total else {}
    conditions |= {name: has_label(i) for i, name in enumerate(names.values())}
    labelled = F.max(has_any_label()).alias("labelled")
    counted = reduced.groupBy(day).agg(
        *(
            F.count_if(condition if count_missing_user else condition & F.col(user).isNotNull()).alias(name)
            for name, condition in conditions.items()
        ),
        labelled,
    )
    return counted.where("labelled").drop("labelled")


def daily_users(rows: DataFrame, day: str, user: str, name: str = "total_users") -> DataFrame:
    """Distinct users per day, NULL not counted."""
    return count_users(user_days(rows, [day, user]), day, user, {name: F.lit(True)})


def null_if_absent(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL instead of 0 in columns nobody appears in on any day.

    The window spans the daily table, which has one row per calendar day.
    """
    everywhere = Window.partitionBy()
    return daily.withColumns({c: F.when(F.max(c).over(everywhere) > 0, F.col(c)) for c in columns})


def column_presence(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, as (``name``, ``present``), whether somebody appears in it on some day."""
    most = daily.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in columns))
    return most.unpivot([], list(columns), "name", "most").select("name", (F.col("most") > 0).alias("present"))


def present_columns(daily: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns somebody appears in. Runs a job that returns a row per column."""
    present = {row["name"] for row in column_presence(daily, columns).where("present").collect()}
    return [c for c in columns if c in present]
