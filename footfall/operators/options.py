"""What a filter can offer: date bounds and distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v


def date_bounds(rows: DataFrame, day: str) -> DataFrame:
    """One row with the first and last day."""
    return rows.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def filter_options(rows: DataFrame, columns: Sequence[str], drop_unknown: bool = False) -> DataFrame:
    """Sorted distinct values per column, as (``dimension``, ``option``) rows.

    All columns are read in one pass, and values are made distinct before they
    are shuffled. NULL and '' are no options; with ``drop_unknown`` neither are
    none, unknown and nan in any case.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("option")) for c in columns))
    options = rows.select(F.explode(pairs).alias("pair")).select("pair.*").where(F.col("option") != "")
    if drop_unknown:
        options = options.where(~F.lower("option").isin(list(v.UNKNOWN_OPTIONS)))
    return options.distinct().orderBy("dimension", "option")
