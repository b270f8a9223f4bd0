"""The input tables, derived from the plain ``events`` test table.

The rules below are those of FIXTURES.md, section 2. They touch every row of
the given table and invent no rows of their own. Beyond them, the user id among the
properties has a spelling and gaps of its own, so that it is not mistaken for the one among the
parameters, and the app version changes from event to event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schema
from footfall import vocabulary as v
from footfall.functions.text import text_array
from footfall.sources.tables import Tables

# --- fixed values: lists the derivation picks from ----------------------------
SCREENS = (*v.ONBOARDING_SCREENS, "kyun_karni_hai_beesi", "beesi_kya_hai", v.GOAL_SCREEN)
GOALS = (
    "Buy iPhone 15",
    "gadgets",
    "Electronics",
    "New Laptop",
    "Travel to Goa",
    "Luxury",
    "Shopping",
    "Jewellery",
    "Savings",
    "Host Party",
    "Bike",
    "Car",
    "Online Education",
    "Scarf",
    "Wedding",
    None,
)
SOURCES = (
    "set_now_home_screen",
    "create_beesi_home_screen",
    "edit_goal_settings_screen",
    "set_now_groups_screen",
    "create_beesi_groups_screen",
    "set_goal_reward_screen",
    "unknown_source",
    None,
)
WEB_CYCLE = (
    "home_page_view",
    "Open_App_Playstore",
    "Open_App_Appstore",
    "Open_App_Yes_But_Kaise",
    "Open_App_Haan_Dost_Hain",
    "Open_App_Nudge_Floating",
    "Open_App_Nudge_1",
    "Open_App_Nudge_2",
    "Open_App_Whatsapp_Share_App_With_Friends",
    "other_event",
)
COUNTRIES = ("IN", "US", "", None)


def pick(values, index: Column) -> Column:
    return F.get(text_array(values), index.cast("int"))


def epoch_millis(ts: Column) -> Column:
    """Floored epoch milliseconds of a zone-less timestamp, in any session zone."""
    seconds = F.date_part(F.lit("SECOND"), ts)
    in_day = (F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000 + F.floor(seconds * 1000)
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86_400_000 + in_day


def flat_events(raw: DataFrame) -> DataFrame:
    """One flat row per event; a NULL stands for an absent array element."""
    e, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = raw.select(e.alias("e"), u.alias("u"), t.alias("t"), "ts", k.alias("k"))
    e, u, t, k = (F.col(c) for c in "eutk")
    name = (
        F.when(t == "signup", F.when(k % 4 == 0, v.FIRST_OPEN).otherwise(v.SCREEN_LOAD))
        .when(t == "view", v.SCREEN_LOAD)
        .when(t == "click", v.VIEW_CLICK)
        .when(t == "purchase", F.when(k % 2 == 0, v.PLAY_PLAYER).otherwise(v.PAUSE_PLAYER))
        .when(t == "error", F.when(k % 2 == 0, v.SCROLL).otherwise("app_exception"))
    )
    base = base.withColumn("event_name", name)
    n = F.col("event_name")
    on_screen = n.isin(v.SCREEN_LOAD, v.VIEW_CLICK)
    base = base.withColumn(
        "screen_name",
        F.when(on_screen, pick(SCREENS, (e * 7 + k) % 13)).when(
            n.isin(v.PLAY_PLAYER, v.PAUSE_PLAYER), "beesi_kya_hai"
        ),
    )
    s = F.col("screen_name")
    click = n == v.VIEW_CLICK
    view_id = (
        F.when(s == "home_screen", pick(("kyun_karni_hai_beesi", "beesi_kya_hai", "other"), k % 3))
        .when(s == "kyun_karni_hai_beesi", pick(("cool", "back_button", "other"), k % 3))
        .when(s == "beesi_kya_hai", pick(("back_button", "create_beesi_group", "other"), k % 3))
    )
    watched = F.concat(
        F.floor(k * 2 / 60).cast("string"), F.lit(":"), F.lpad((k * 2 % 60).cast("string"), 2, "0")
    )
    earlier = F.floor(k / 4) % 3
    goal_click = click & (s == v.GOAL_SCREEN)
    custom = F.when(k % 13 != 0, F.when(k % 11 == 0, 1).otherwise(0))
    user = F.when(u % 5 != 0, u.cast("string"))
    return base.select(
        "e",
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
        F.concat(F.lit("u"), u.cast("string")).alias("user_pseudo_id"),
        "event_name",
        F.when(e % 10 < 8, v.ANDROID).when(e % 10 == 8, "IOS").otherwise("WEB").alias("platform"),
        "screen_name",
        F.when(click, view_id).alias("view_id"),
        F.when(n == v.PAUSE_PLAYER, F.when(k < 5, "0:00").otherwise(watched)).alias("duration"),
        F.when((n == v.SCROLL) & (k % 20 != 0), F.floor(k / 10) * 10 + 10).alias("percent_scrolled"),
        F.when((n == v.FIRST_OPEN) & (earlier != 0), earlier - 1).alias("previous_first_open_count"),
        user.alias("user_id"),
        F.when(u % 7 != 0, F.concat(F.lit("p"), u.cast("string"))).alias("property_user_id"),
        F.when(goal_click, pick(GOALS, k % 16)).alias("goal_selected"),
        F.when(goal_click, custom).cast("bigint").alias("is_custom_goal"),
        F.when(on_screen & (e % 2 == 0), pick(SOURCES, F.floor(e / 2) % 8)).alias("source"),
        F.when(e % 17 != 0, epoch_millis(F.col("ts")) - (e % 3) * 86_400_000).alias("first_open_time"),
        pick(("male", "female", None), u % 3).alias("gender"),
        pick(("18-24", "25-34", "35-44", None), u % 4).alias("age"),
        pick((None, "student", "salaried", "self_employed", None), u % 5).alias("profession"),
        *places(u),
        pick(("1.0.0", "1.1.0", "2.0.0"), (u + F.floor(e / 3)) % 3).alias("version"),
        F.concat(F.lit("Android "), (u % 5 + 10).cast("string")).alias("operating_system_version"),
    )


def places(u: Column) -> list[Column]:
    return [
        pick(COUNTRIES, u % 4).alias("country"),
        F.when(u % 6 != 5, F.concat(F.lit("R"), (u % 6).cast("string"))).alias("region"),
        F.concat(F.lit("C"), (u % 7).cast("string")).alias("city"),
    ]


def _keyed(strings: dict[str, str], ints: dict[str, str]) -> Column:
    def element(key: str, column: str, is_string: bool) -> Column:
        text = F.col(column).cast("string") if is_string else F.lit(None).cast("string")
        number = F.lit(None).cast("bigint") if is_string else F.col(column).cast("bigint")
        value = F.struct(text.alias("string_value"), number.alias("int_value"))
        return F.when(F.col(column).isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))

    elements = [element(key, c, True) for key, c in strings.items()]
    elements += [element(key, c, False) for key, c in ints.items()]
    return F.array_compact(F.array(*elements)).cast(schema.KEYED)


def nested_events(raw: DataFrame) -> DataFrame:
    """The nested event table, with ``event_id`` as an extra tiebreak column.

    Rows pass through a generator, as a scan would stand between these
    expressions and a report: predicates are not rewritten into them.
    """
    row = F.struct(
        "event_name",
        "platform",
        "user_pseudo_id",
        _keyed(
            {
                v.SCREEN_NAME: "screen_name",
                v.VIEW_ID: "view_id",
                v.DURATION: "duration",
                v.USER_ID: "user_id",
                v.GOAL_SELECTED: "goal_selected",
                v.SOURCE: "source",
            },
            {
                v.PERCENT_SCROLLED: "percent_scrolled",
                v.PREVIOUS_FIRST_OPEN_COUNT: "previous_first_open_count",
                v.IS_CUSTOM_GOAL: "is_custom_goal",
            },
        ).alias("event_params"),
        _keyed(
            {v.USER_ID: "property_user_id", v.USER_GENDER: "gender", v.USER_AGE: "age", v.USER_PROFESSION: "profession"},
            {v.FIRST_OPEN_TIME: "first_open_time"},
        ).alias("user_properties"),
        F.struct("country", "region", "city").alias("geo"),
        F.struct("version").alias("app_info"),
        F.struct("operating_system_version").alias("device"),
        "event_date",
        F.col("e").alias("event_id"),
    )
    return flat_events(raw).select(F.inline(F.array(row)))


def web_user_data(raw: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    country, region, city = places(u)
    return raw.where(F.col("event_type").isin("view", "click", "signup")).select(
        F.to_date("ts").alias("Dates"),
        pick(WEB_CYCLE, (e + k) % 10).alias("Event_Name"),
        pick(("mobile", "desktop", None), e % 3).alias("Device"),
        country.alias("Country"),
        region.alias("Region"),
        city.alias("City"),
        F.when(e % 97 != 0, F.concat(F.lit("u"), u.cast("string"))).alias("User_ID"),
    )


def new_user(raw: DataFrame) -> DataFrame:
    """First day per user, and the day after it as well for every tenth user."""
    first = raw.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("day"))
    days = F.when(F.col("user_id") % 10 == 0, F.array("day", F.date_add("day", 1))).otherwise(F.array("day"))
    return first.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("User_ID"), F.explode(days).alias("Dates")
    )


def tables_of(raw: DataFrame) -> Tables:
    """The three input tables over the plain event rows."""
    return Tables(nested_events(raw), web_user_data(raw), new_user(raw))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The three input tables over a test-data folder."""
    return tables_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def write_tables(given: Tables, path: str) -> None:
    """The tables as Parquet, events in one folder per day.

    A rebalance by day keeps files few, and splits a day with most of the rows.
    """
    given.events.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(f"{path}/events")
    given.web_user_data.write.parquet(f"{path}/web_user_data")
    given.new_user.write.parquet(f"{path}/new_user")
