"""Hand-made input rows."""

from __future__ import annotations

import datetime as dt

from footfall import schema


def _keyed(pairs):
    """Array elements from a dict, or from (key, value) pairs to allow repeats; None stays None."""
    if pairs is None:
        return None
    items = pairs.items() if isinstance(pairs, dict) else pairs
    return [
        {"key": k, "value": {"string_value": x if isinstance(x, str) else None, "int_value": x if isinstance(x, int) else None}}
        for k, x in items
    ]


def event(
    name,
    user="a",
    day="20240101",
    platform="ANDROID",
    params=(),
    props=(),
    country=None,
    region=None,
    city=None,
    version=None,
    os_version=None,
):
    return {
        "event_name": name,
        "platform": platform,
        "user_pseudo_id": user,
        "event_params": _keyed(params),
        "user_properties": _keyed(props),
        "geo": {"country": country, "region": region, "city": city},
        "app_info": {"version": version},
        "device": {"operating_system_version": os_version},
        "event_date": day,
    }


def events(spark, *rows):
    return spark.createDataFrame(list(rows), schema.EVENTS)


def visit(day, name="home_page_view", user="w", device=None, country=None, region=None, city=None):
    return (day and dt.date.fromisoformat(day), name, device, country, region, city, user)


def web(spark, *rows):
    return spark.createDataFrame(list(rows), schema.WEB)


def first_seen(spark, *rows):
    return spark.createDataFrame([(u, d and dt.date.fromisoformat(d)) for u, d in rows], schema.NEW_USER)


def dicts(frame):
    return [row.asDict() for row in frame.collect()]
