"""Report filters.

Filters act on rows before users are counted, so they change the denominators
of percentages as well. An empty selection means no filter.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v
from footfall.functions.dates import compact_day


@dataclass(frozen=True)
class FilterSpec:
    """Selections a report is asked for.

    ``start`` and ``end`` are inclusive. Every other field holds the accepted
    values of the dimension it is named after.
    """

    start: dt.date | None = None
    end: dt.date | None = None
    os_version: Sequence[str] = ()
    app_version: Sequence[str] = ()
    country: Sequence[str] = ()
    region: Sequence[str] = ()
    city: Sequence[str] = ()
    install_type: Sequence[str] = ()
    gender: Sequence[str] = ()
    age: Sequence[str] = ()
    profession: Sequence[str] = ()
    device: Sequence[str] = ()
    user_type: Sequence[str] = ()

    def __post_init__(self) -> None:
        texts = [field.name for field in fields(self) if isinstance(getattr(self, field.name), str)]
        if texts:
            raise TypeError(f"{', '.join(texts)}: give a list of values, not a text")

    def selected(self, names: Iterable[str]) -> dict[str, list[str]]:
        """The dimensions among ``names`` that have a selection."""
        return {name: list(getattr(self, name)) for name in names if getattr(self, name)}

    def only(self, *names: str) -> FilterSpec:
        """Itself, if no dimension outside ``names`` has a selection."""
        dimensions = {field.name for field in fields(self)} - {"start", "end"}
        strangers = sorted(self.selected(dimensions - set(names)))
        if strangers:
            raise ValueError(f"this report has no filter for {', '.join(strangers)}")
        return self


VERSIONS = ("os_version", "app_version")
PLACES = ("country", "region", "city")
PERSON = ("gender", "age", "profession")
NO_FILTERS = FilterSpec()


def between_event_days(
    rows: DataFrame, column: str, start: dt.date | None, end: dt.date | None
) -> DataFrame:
    """Inclusive range on a ``yyyyMMdd`` text column, in the column's own spelling.

    Comparing text with text keeps the predicate usable for partition pruning.
    """
    return between_days(
        rows, F.col(column), start and F.lit(compact_day(start)), end and F.lit(compact_day(end))
    )


def between_days(rows: DataFrame, column: Column, start: Column | None, end: Column | None) -> DataFrame:
    """Inclusive range with optional ends."""
    if start is not None:
        rows = rows.where(column >= start)
    if end is not None:
        rows = rows.where(column <= end)
    return rows


def between_if_both(
    rows: DataFrame, column: Column, start: dt.date | None, end: dt.date | None
) -> DataFrame:
    """Inclusive range that applies only when both ends are given."""
    if start is None or end is None:
        return rows
    return rows.where(column.between(F.lit(start), F.lit(end)))


def between_booked_days(
    rows: DataFrame, column: Column, start: Column | None, end: Column | None, booked_on: Column
) -> DataFrame:
    """Inclusive range where rows without a day count as ``booked_on``.

    Tests the raw column beside the missing case instead of coalescing the two,
    so that the range still reaches the scan.
    """
    if start is not None:
        rows = rows.where((column >= start) | (column.isNull() & (booked_on >= start)))
    if end is not None:
        rows = rows.where((column <= end) | (column.isNull() & (booked_on <= end)))
    return rows


def where_selected(rows: DataFrame, selections: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose columns hold one of the selected values; NULL never does."""
    for column, values in selections.items():
        if values:
            rows = rows.where(F.col(column).isin(list(values)))
    return rows


def where_selected_or_unknown(rows: DataFrame, selections: dict[str, Sequence[str]]) -> DataFrame:
    """The same with NULL read as ``Unknown``."""
    for column, values in selections.items():
        if values:
            accepted = F.col(column).isin(list(values))
            rows = rows.where(accepted | F.col(column).isNull() if v.UNKNOWN in values else accepted)
    return rows


def apply_filters(rows: DataFrame, spec: FilterSpec, day: str, columns: dict[str, str]) -> DataFrame:
    """Day range and every selection of ``spec``; ``columns`` maps dimension to column."""
    rows = between_event_days(rows, day, spec.start, spec.end)
    return where_selected(rows, {columns[name]: values for name, values in spec.selected(columns).items()})


def meets(spec: FilterSpec, day: str, columns: dict[str, str]) -> Column:
    """What :func:`apply_filters` keeps, as a condition: true for those rows, false or NULL for others."""
    condition = F.lit(True)
    if spec.start is not None:
        condition = condition & (F.col(day) >= F.lit(compact_day(spec.start)))
    if spec.end is not None:
        condition = condition & (F.col(day) <= F.lit(compact_day(spec.end)))
    for name, values in spec.selected(columns).items():
        if values:
            condition = condition & F.col(columns[name]).isin(list(values))
    return condition


def on_android(events: DataFrame) -> DataFrame:
    return events.where(F.col("platform") == v.ANDROID)


def of_events(rows: DataFrame, *names: str, column: str = "event_name") -> DataFrame:
    """Rows of the named events, case-sensitive."""
    names_ = list(names)
    return rows.where(F.col(column).isin(names_) if len(names_) > 1 else F.col(column) == names_[0])
