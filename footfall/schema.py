"""Declared schemas of the three input tables.

Only the fields a report reads are declared, so a wider export is clipped to
them by the Parquet reader, down to single fields inside the keyed arrays.
"""

from __future__ import annotations

KEYED = "array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>"

EVENTS = f"""
    event_name string,
    platform string,
    user_pseudo_id string,
    event_params {KEYED},
    user_properties {KEYED},
    geo struct<country:string,region:string,city:string>,
    app_info struct<version:string>,
    device struct<operating_system_version:string>,
    event_date string
"""

WEB = "Dates date, Event_Name string, Device string, Country string, Region string, City string, User_ID string"

NEW_USER = "User_ID string, Dates date"
