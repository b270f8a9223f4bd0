"""Lookups in keyed arrays: ``array<struct<key, value<string_value, int_value>>>``.

A lookup is ``get(values, array_position(keys, key) - 1)``. Unlike a lambda
``filter`` this stays in generated code, and the optimizer still prunes the
array to the key and the one value field that is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_PARAMS = "event_params"
USER_PROPERTIES = "user_properties"


def keyed_value(array: str, key: str, field: str, strict: bool = False) -> Column:
    """Value of the first element whose key is ``key``; NULL without one.

    ``strict=True`` fails the query when a key occurs twice in one array.
    """
    keys = F.col(f"{array}.key")
    position = F.array_position(keys, F.lit(key)) - 1
    value = F.get(F.col(f"{array}.value.{field}"), position.cast("int"))
    if strict:
        matches = F.size(keys) - F.size(F.array_remove(keys, key))
        value = F.when(matches > 1, F.raise_error(F.lit(f"{array} holds {key} more than once"))).otherwise(value)
    return value


def param_string(key: str, strict: bool = False) -> Column:
    return keyed_value(EVENT_PARAMS, key, "string_value", strict)


def param_int(key: str, strict: bool = False) -> Column:
    return keyed_value(EVENT_PARAMS, key, "int_value", strict)


def property_string(key: str, strict: bool = False) -> Column:
    return keyed_value(USER_PROPERTIES, key, "string_value", strict)


def property_int(key: str, strict: bool = False) -> Column:
    return keyed_value(USER_PROPERTIES, key, "int_value", strict)


def explode_params(events: DataFrame, only_where: Column | None = None) -> DataFrame:
    """One row per (event, parameter) as ``param``; events without any vanish.

    With ``only_where``, all other events keep a single empty ``param``: that
    keeps the event itself without multiplying rows nobody reads.
    """
    if only_where is None:
        return events.withColumn("param", F.explode(EVENT_PARAMS))
    keys = F.col(f"{EVENT_PARAMS}.key")
    pairs = F.arrays_zip(keys.alias("key"), F.col(f"{EVENT_PARAMS}.value.int_value").alias("int_value"))
    empty = F.expr("array(named_struct('key', CAST(NULL AS STRING), 'int_value', CAST(NULL AS BIGINT)))")
    return events.withColumn("param", F.explode(F.when(only_where, pairs).when(F.size(keys) > 0, empty)))
