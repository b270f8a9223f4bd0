"""Registered queries: one per operator and report, over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import footfall as ff
from catalog import adapter
from footfall import vocabulary as v
from footfall.functions import classify
from footfall.functions.dates import duration_seconds, format_day, parse_day, report_day
from footfall.functions.numbers import percent, round2
from footfall.functions.params import explode_params, param_int, param_string, property_int, property_string
from footfall.operators import filters as fl
from footfall.operators import goals as g
from footfall.operators import options as opt
from footfall.operators import user_days as ud
from footfall.operators.first_seen import as_user_types, with_first_seen
from footfall.operators.scroll import bounce_percent, max_scroll, scroll_counts, with_max_scroll
from footfall.plans import extracts as x
from footfall.plans import journeys as j
from footfall.plans import reports as r
from footfall.sources import by_user, shared, state
from footfall.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}

TIEBREAK = ["event_id"]
BUCKETS = 16
EARLY, LATE = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
WEB_LABELS = {label: v.snake(label) for label in v.WEB_EVENTS}
EXPLORE_NAMES = [v.snake(label) for label in v.EXPLORE_LABELS]
WATCH_NAMES = [v.snake(label) for label in v.WATCH_LABELS]


def registered(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Registers a function of the tables under its own name.

    A trailing underscore only avoids a clash with what the function calls.
    """
    BUILDERS[build.__name__.rstrip("_")] = build
    return build


def _over_folder(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(adapter.tables(spark, sf_dir))


def _goal_rows(t: Tables) -> DataFrame:
    return ff.goal_rows(t.events, TIEBREAK)


def _latest(t: Tables) -> DataFrame:
    return r.latest_goals(_goal_rows(t), tiebreak=TIEBREAK)


def _visits(t: Tables) -> DataFrame:
    seen = x.user_days_of(x.on_web_events(t.web_user_data))
    return with_max_scroll(seen, max_scroll(t.events, report_day(None)))


def _explore_counts(t: Tables) -> DataFrame:
    return r.explore_counts(x.explore_rows(t.events))


# --- sources ------------------------------------------------------------------


@registered
def scan_events(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        "event_date",
        "event_name",
        "platform",
        "user_pseudo_id",
        F.size("event_params").cast("bigint").alias("n_params"),
        F.size("user_properties").cast("bigint").alias("n_properties"),
        *x.dimensions(),
    )


@registered
def scan_web(t: Tables) -> DataFrame:
    return t.web_user_data


@registered
def scan_new_user(t: Tables) -> DataFrame:
    return t.new_user


@registered
def run_sql(t: Tables) -> DataFrame:
    return ff.run_sql(
        t, "SELECT event_name, count(*) AS n, count(DISTINCT user_pseudo_id) AS users FROM {events} GROUP BY event_name"
    )


@registered
def reuse_extract(t: Tables) -> DataFrame:
    both = ff.goal_reports(_goal_rows(t), tiebreak=TIEBREAK)
    items = [
        F.struct(F.lit(report).alias("report"), F.lit(item).alias("item"), F.col(f"{report}.{name}").alias("pct"))
        for report, columns in (("goals", r.GOAL_COLUMNS), ("sources", r.SOURCE_COLUMNS))
        for item, name in columns.items()
    ]
    return both.select(F.inline(F.array(*items))).where(F.col("pct").isNotNull())


# --- sinks --------------------------------------------------------------------


@registered
def fmt_counts(t: Tables) -> DataFrame:
    return ff.format_report(ff.overview(t.events), "overview")


@registered
def fmt_percent(t: Tables) -> DataFrame:
    return ff.format_report(ff.scroll_depth(t.events, t.web_user_data, t.new_user), "scroll_depth")


# --- projections --------------------------------------------------------------


@registered
def explode_params_(t: Tables) -> DataFrame:
    return explode_params(t.events).select(
        "event_id", "event_name", "param.key", "param.value.string_value", "param.value.int_value"
    )


@registered
def explode_param_max(t: Tables) -> DataFrame:
    wanted = F.col("param.key") == v.PREVIOUS_FIRST_OPEN_COUNT
    return (
        explode_params(t.events)
        .groupBy("event_date", "user_pseudo_id")
        .agg(F.max(F.when(wanted, F.col("param.value.int_value"))).alias("previous_first_open_count"))
    )


@registered
def param_string_(t: Tables) -> DataFrame:
    wanted = {
        "screen_name": v.SCREEN_NAME,
        "view_id": v.VIEW_ID,
        "duration": v.DURATION,
        "user_id": v.USER_ID,
        "goal_selected": v.GOAL_SELECTED,
        "sources": v.SOURCE,
    }
    return t.events.select("event_id", *(param_string(key).alias(name) for name, key in wanted.items()))


@registered
def param_int_(t: Tables) -> DataFrame:
    wanted = (v.PERCENT_SCROLLED, v.PREVIOUS_FIRST_OPEN_COUNT, v.IS_CUSTOM_GOAL)
    return t.events.select("event_id", *(param_int(key, strict=True).alias(key) for key in wanted))


@registered
def user_prop_string(t: Tables) -> DataFrame:
    wanted = {"user_id": v.USER_ID, "age": v.USER_AGE, "profession": v.USER_PROFESSION, "gender": v.USER_GENDER}
    return t.events.select("event_id", *(property_string(key).alias(name) for name, key in wanted.items()))


@registered
def user_prop_int(t: Tables) -> DataFrame:
    return t.events.select("event_id", property_int(v.FIRST_OPEN_TIME).alias("first_open_time"))


@registered
def struct_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", *x.dimensions())


@registered
def rename_columns(t: Tables) -> DataFrame:
    return ff.with_titles(ff.scroll_depth(t.events, t.web_user_data, t.new_user), "scroll_depth")


@registered
def order_columns(t: Tables) -> DataFrame:
    wanted = ["dates", "home_page_view", "open_app_appstore", "open_app_playstore"]
    return ff.web_events(t.web_user_data, t.new_user).select(*wanted)


@registered
def goal_extract(t: Tables) -> DataFrame:
    return _goal_rows(t)


# --- filters ------------------------------------------------------------------


@registered
def filter_platform(t: Tables) -> DataFrame:
    return fl.on_android(t.events).select("event_id", "event_date", "event_name")


@registered
def filter_event(t: Tables) -> DataFrame:
    return fl.of_events(t.events, v.SCROLL).select("event_id", "event_date", "platform")


@registered
def filter_event_in(t: Tables) -> DataFrame:
    return fl.of_events(t.events, *v.CUSTOM_EVENTS).select("event_id", "event_date", "event_name")


@registered
def filter_web_events(t: Tables) -> DataFrame:
    return x.on_web_events(t.web_user_data).select("Dates", "Event_Name", "User_ID")


@registered
def filter_screen_in(t: Tables) -> DataFrame:
    return x.onboarding_events(t.events)


@registered
def filter_logged_in(t: Tables) -> DataFrame:
    def via(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("via"), "event_id", "user_id")

    return via("property", x.logged_in_by_property(t.events)).unionByName(via("param", x.logged_in_by_param(t.events)))


@registered
def filter_first_day(t: Tables) -> DataFrame:
    return x.on_first_day(t.events).select("event_id", "event_date")


@registered
def filter_explore_actions(t: Tables) -> DataFrame:
    return x.explore_rows(t.events).groupBy("event_date", "user_id", "actions").agg(F.count("*").alias("n"))


@registered
def filter_date_range(t: Tables) -> DataFrame:
    return fl.between_event_days(t.events, "event_date", EARLY, LATE).select("event_id", "event_date")


@registered
def filter_date_range_opt(t: Tables) -> DataFrame:
    day = parse_day(F.col("event_date"))

    def given(name: str, end: dt.date | None) -> DataFrame:
        return fl.between_if_both(t.events, day, EARLY, end).select(F.lit(name).alias("given"), "event_id")

    return given("both", LATE).unionByName(given("start", None))


@registered
def filter_dims(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("app_info.version").alias("app_version"), F.col("geo.country").alias("country"))
    return fl.where_selected(rows, {"app_version": ["1.0.0", "2.0.0"], "country": ["IN"]})


@registered
def filter_dims_unknown(t: Tables) -> DataFrame:
    rows = fl.where_selected_or_unknown(t.web_user_data, {"Device": ["mobile", "Unknown"], "Country": ["IN", "US"]})
    return rows.select("Dates", "User_ID", "Device", "Country")


@registered
def filter_bundle(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(
        start=dt.date(2024, 1, 3),
        end=dt.date(2024, 1, 25),
        os_version=["Android 11"],
        app_version=["1.0.0", "1.1.0"],
        country=["IN", "US"],
        region=["R1", "R3"],
        city=["C0", "C1", "C2", "C3", "C4"],
        gender=["male", "female"],
        age=["18-24", "25-34"],
        profession=["student"],
    )
    return fl.apply_filters(_goal_rows(t), spec, "event_date", {name: name for name in r.GOAL_FILTERS})


@registered
def filter_goal_clicks(t: Tables) -> DataFrame:
    return g.goal_clicks(_goal_rows(t)).select("event_id", "user_id", "goal_selected", "is_custom_goal")


@registered
def filter_mapped_sources(t: Tables) -> DataFrame:
    rows = _goal_rows(t).withColumn("source_category", classify.source_category(F.col("sources")))
    return rows.where(F.col("source_category").isNotNull()).select("event_id", "user_id", "source_category")


@registered
def empty_report(t: Tables) -> DataFrame:
    rows = _goal_rows(t)
    nothing = r.goal_categories(rows, ff.FilterSpec(country=["nowhere"]), TIEBREAK)
    return nothing.unionByName(r.goal_categories(rows, tiebreak=TIEBREAK))


# --- joins --------------------------------------------------------------------


@registered
def join_newuser_events(t: Tables) -> DataFrame:
    return x.new_user_rows(t.events)


@registered
def join_first_seen(t: Tables) -> DataFrame:
    return x.web_rows(t.web_user_data, t.new_user)


@registered
def join_scroll(t: Tables) -> DataFrame:
    return _visits(t)


@registered
def join_full_daily(t: Tables) -> DataFrame:
    return _explore_counts(t).select("event_date", "total_users", *EXPLORE_NAMES)


@registered
def join_left_daily(t: Tables) -> DataFrame:
    return _explore_counts(t).select("event_date", "total_users", *EXPLORE_NAMES, *WATCH_NAMES)


@registered
def daily_total_users(t: Tables) -> DataFrame:
    return ud.daily_users(fl.on_android(t.events), "event_date", "user_pseudo_id")


# --- aggregations -------------------------------------------------------------


@registered
def user_day_flags(t: Tables) -> DataFrame:
    return x.user_day_flags(t.events)


@registered
def overview_daily(t: Tables) -> DataFrame:
    return r.overview_counts(t.events)


@registered
def pivot_distinct(t: Tables) -> DataFrame:
    rows = x.total_user_rows(t.events).withColumn("app_event", F.coalesce("app_event", F.lit(v.NO_EVENT)))
    labels = (*v.ONBOARDING_LABELS, v.NO_EVENT, v.NO_CUSTOM_EVENT)
    names = {label: v.snake(label) for label in labels}
    return ud.pivot_users(rows, "event_date", "user_pseudo_id", "app_event", names, total="total_users")


@registered
def pivot_distinct_null(t: Tables) -> DataFrame:
    return ud.pivot_users(
        x.on_web_events(t.web_user_data), "Dates", "User_ID", "Event_Name", WEB_LABELS, count_missing_user=True
    )


@registered
def max_scroll_(t: Tables) -> DataFrame:
    return max_scroll(t.events, report_day(None))


@registered
def distinct_rows(t: Tables) -> DataFrame:
    return x.scroll_rows(t.events, t.web_user_data, t.new_user)


@registered
def interacted_users(t: Tables) -> DataFrame:
    return scroll_counts(_visits(t)).select("Dates", "total_users", "interacted_users")


@registered
def scroll_thresholds(t: Tables) -> DataFrame:
    return scroll_counts(_visits(t))


@registered
def watch_buckets(t: Tables) -> DataFrame:
    shares = (percent(F.col(c), F.col("total_users")).alias(c) for c in WATCH_NAMES)
    return _explore_counts(t).select("event_date", "total_users", *shares)


@registered
def latest_goal(t: Tables) -> DataFrame:
    return _latest(t)


@registered
def goal_counts(t: Tables) -> DataFrame:
    return g.goal_shares(_latest(t))


@registered
def goal_totals(t: Tables) -> DataFrame:
    counts = g.source_counts(_goal_rows(t), r.SOURCE_COLUMNS)
    return counts.select(
        F.col("total_logged_in_users").alias("total_users"), F.col("users_who_set_goals").alias("users_with_goals")
    )


@registered
def source_counts(t: Tables) -> DataFrame:
    return g.source_counts(_goal_rows(t), r.SOURCE_COLUMNS)


@registered
def goals_wide(t: Tables) -> DataFrame:
    return g.goals_wide(_latest(t), r.GOAL_COLUMNS)


@registered
def sources_wide(t: Tables) -> DataFrame:
    return g.source_shares(_goal_rows(t), r.SOURCE_COLUMNS)


@registered
def date_bounds(t: Tables) -> DataFrame:
    return opt.date_bounds(fl.on_android(t.events), "event_date")


@registered
def filter_options(t: Tables) -> DataFrame:
    return opt.filter_options(_goal_rows(t), list(x.DIMENSIONS))


@registered
def filter_options_known(t: Tables) -> DataFrame:
    rows = x.on_web_events(t.web_user_data).select(
        F.coalesce("Device", F.lit("Unknown")).alias("Device"),
        F.coalesce("Country", F.lit("none")).alias("Country"),
        F.coalesce("Region", F.lit("NaN")).alias("Region"),
        "City",
    )
    return opt.filter_options(rows, rows.columns, drop_unknown=True)


@registered
def other_goals(t: Tables) -> DataFrame:
    return g.other_goals(_latest(t))


# --- metrics ------------------------------------------------------------------


@registered
def pct_keep_null(t: Tables) -> DataFrame:
    return ff.overview(t.events).select("dates", percent(F.col("reinstalls"), F.col("fresh_installs")).alias("pct"))


@registered
def pct_fill_zero(t: Tables) -> DataFrame:
    return ff.overview(t.events).select(
        "dates", percent(F.col("reinstalls"), F.col("fresh_installs"), on_zero="zero").alias("pct")
    )


@registered
def pct_guarded(t: Tables) -> DataFrame:
    shares = (percent(F.col(c), F.col("total_users"), on_zero="zero").alias(c) for c in EXPLORE_NAMES)
    return _explore_counts(t).select("event_date", "total_users", *shares)


@registered
def bounce_rate(t: Tables) -> DataFrame:
    return scroll_counts(_visits(t)).select("Dates", bounce_percent().alias("bounce_pct"))


@registered
def round_half_even(t: Tables) -> DataFrame:
    share = percent(F.col("event_id") % 800, F.lit(800))  # every fourth share ends in a half
    return t.events.select("event_id", round2(share).alias("pct"))


def _with_stranger(t: Tables) -> DataFrame:
    names = WEB_LABELS | {"never_seen": "never_seen"}
    return ud.pivot_users(
        x.on_web_events(t.web_user_data), "Dates", "User_ID", "Event_Name", names, count_missing_user=True
    )


@registered
def missing_zero(t: Tables) -> DataFrame:
    return _with_stranger(t)


@registered
def missing_omit(t: Tables) -> DataFrame:
    return ud.column_presence(_with_stranger(t), [*WEB_LABELS.values(), "never_seen"])


@registered
def missing_null(t: Tables) -> DataFrame:
    return ud.null_if_absent(_with_stranger(t), [*WEB_LABELS.values(), "never_seen"])


@registered
def fill_zero_all(t: Tables) -> DataFrame:
    """Explore cells that nobody reached are NULL in a pivot, on whatever days that happens."""
    reached = {name: F.nullif(F.col(name), F.lit(0)) for name in EXPLORE_NAMES}
    return _explore_counts(t).select("event_date", "total_users", *EXPLORE_NAMES).withColumns(reached).na.fill(0)


@registered
def fill_zero_one(t: Tables) -> DataFrame:
    """Visitors who did not scroll on a day have no depth after the join."""
    return _visits(t).na.fill(0, ["max_scroll_percent"])


# --- classification -----------------------------------------------------------


@registered
def user_type(t: Tables) -> DataFrame:
    return x.classified_user_days(t.events).select("event_date", "user_pseudo_id", "user_type")


@registered
def install_type(t: Tables) -> DataFrame:
    return x.new_installs(t.events)


@registered
def web_user_type(t: Tables) -> DataFrame:
    return as_user_types(with_first_seen(x.user_days_of(x.on_web_events(t.web_user_data)), t.new_user))


@registered
def label_onboarding(t: Tables) -> DataFrame:
    label = classify.onboarding_label(F.col("event_name"), F.col("screen_name"))
    return x.onboarding_events(t.events).select(
        "event_date", "user_pseudo_id", "event_name", "screen_name", label.alias("label")
    )


@registered
def label_onboarding_all(t: Tables) -> DataFrame:
    return x.total_user_rows(t.events)


@registered
def label_explore(t: Tables) -> DataFrame:
    return x.explore_rows(t.events).drop("action_number")


@registered
def goal_category(t: Tables) -> DataFrame:
    category = classify.goal_category(F.col("is_custom_goal"), F.col("goal_selected"))
    return g.goal_clicks(_goal_rows(t)).select(
        "event_id", "goal_selected", "is_custom_goal", category.alias("goal_category")
    )


@registered
def source_category(t: Tables) -> DataFrame:
    category = classify.source_category(F.col("sources"))
    return _goal_rows(t).select("event_id", "sources", category.alias("source_category"))


# --- scalar functions ---------------------------------------------------------


@registered
def coalesce_defaults(t: Tables) -> DataFrame:
    wanted = {"age": v.USER_AGE, "profession": v.USER_PROFESSION, "gender": v.USER_GENDER}
    return t.events.select(
        "event_id",
        *(F.coalesce(property_string(key), F.lit(v.NOT_AVAILABLE)).alias(name) for name, key in wanted.items()),
    )


@registered
def parse_date(t: Tables) -> DataFrame:
    return t.events.select("event_id", parse_day(F.col("event_date")).alias("day"))


@registered
def format_date(t: Tables) -> DataFrame:
    return t.events.select("event_id", format_day(parse_day(F.col("event_date"))).alias("day"))


@registered
def date_default(t: Tables) -> DataFrame:
    dated = F.when(F.col("Device").isNotNull(), F.col("Dates"))
    rows = t.web_user_data.select(F.coalesce(dated, report_day(dt.date(2024, 2, 1))).alias("Dates"))
    return rows.groupBy("Dates").agg(F.count("*").alias("n"))


@registered
def parse_duration(t: Tables) -> DataFrame:
    text = param_string(v.DURATION)
    return t.events.select("event_id", text.alias("duration"), duration_seconds(text).alias("seconds"))


@registered
def sort_date_desc(t: Tables) -> DataFrame:
    daily = t.events.groupBy("event_date").agg(F.count("*").alias("n"))
    return r.newest_first(daily, parse_day(F.col("event_date")), {"n": F.col("n")})


# --- reports ------------------------------------------------------------------


@registered
def report_overview(t: Tables) -> DataFrame:
    return ff.overview(t.events)


@registered
def report_new_user(t: Tables) -> DataFrame:
    return ff.new_user_onboarding(t.events)


@registered
def report_total_user(t: Tables) -> DataFrame:
    return ff.total_user_onboarding(t.events)


@registered
def report_explore(t: Tables) -> DataFrame:
    return ff.explore_journey(t.events, missing="zero")


@registered
def report_scroll(t: Tables) -> DataFrame:
    return ff.scroll_depth(t.events, t.web_user_data, t.new_user)


@registered
def report_web_events(t: Tables) -> DataFrame:
    return ff.web_events(t.web_user_data, t.new_user)


@registered
def report_goals(t: Tables) -> DataFrame:
    return ff.goal_categories(_goal_rows(t), tiebreak=TIEBREAK)


@registered
def report_sources(t: Tables) -> DataFrame:
    return ff.goal_sources(_goal_rows(t))


@registered
def report_overview_range(t: Tables) -> DataFrame:
    return ff.overview(t.events, ff.FilterSpec(start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 19)))


@registered
def report_new_user_filtered(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(
        start=dt.date(2024, 1, 3),
        end=dt.date(2024, 1, 28),
        install_type=[v.FRESH_INSTALL],
        app_version=["1.0.0", "2.0.0"],
        country=["IN", "US"],
    )
    return ff.new_user_onboarding(t.events, spec)


@registered
def report_new_user_reinstalls(t: Tables) -> DataFrame:
    return ff.new_user_onboarding(t.events, ff.FilterSpec(install_type=[v.REINSTALL]))


@registered
def report_total_user_filtered(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(start=dt.date(2024, 1, 8), region=["R1", "R2"], os_version=["Android 12"])
    return ff.total_user_onboarding(t.events, spec)


@registered
def report_explore_filtered(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(end=dt.date(2024, 1, 25), gender=["NA"], age=["18-24", "NA"])
    return ff.explore_journey(t.events, spec, missing="zero")


@registered
def report_scroll_new_users(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(start=dt.date(2024, 1, 1), user_type=[v.WEB_NEW_USER])
    return ff.scroll_depth(t.events, t.web_user_data, t.new_user, spec)


@registered
def report_scroll_returning(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(end=LATE, user_type=[v.WEB_RETURNING_USER])
    return ff.scroll_depth(t.events, t.web_user_data, t.new_user, spec, report_date=dt.date(2024, 2, 1))


@registered
def report_web_filtered(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(
        start=dt.date(2024, 1, 2),
        end=dt.date(2024, 1, 25),
        device=["mobile", "Unknown"],
        country=["IN", "US"],
        user_type=[v.WEB_RETURNING_USER],
    )
    return ff.web_events(t.web_user_data, t.new_user, spec)


@registered
def report_web_new_users(t: Tables) -> DataFrame:
    return ff.web_events(t.web_user_data, t.new_user, ff.FilterSpec(user_type=[v.WEB_NEW_USER]))


@registered
def report_goals_filtered(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(app_version=["1.0.0", "1.1.0"], end=LATE)
    return ff.goal_categories(_goal_rows(t), spec, TIEBREAK)


@registered
def report_sources_filtered(t: Tables) -> DataFrame:
    return ff.goal_sources(_goal_rows(t), ff.FilterSpec(gender=["female"], start=EARLY))


@registered
def report_custom_goals(t: Tables) -> DataFrame:
    return ff.custom_goals(_goal_rows(t), tiebreak=TIEBREAK)


@registered
def report_custom_goals_filtered(t: Tables) -> DataFrame:
    spec = ff.FilterSpec(city=["C0", "C2", "C3", "C4", "C5", "C6"])
    return ff.custom_goals(_goal_rows(t), spec, TIEBREAK)


# --- one scan for several reports, and their stored state -----------------------

NEW_FILTERED = ff.FilterSpec(
    start=dt.date(2024, 1, 3),
    end=dt.date(2024, 1, 28),
    install_type=[v.FRESH_INSTALL],
    app_version=["1.0.0", "2.0.0"],
    country=["IN", "US"],
)
JOURNEYS = j.JourneyFilters(
    overview=ff.FilterSpec(start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 19)),
    new_users=NEW_FILTERED,
    all_users=ff.FilterSpec(start=dt.date(2024, 1, 8), region=["R1", "R2"], os_version=["Android 12"]),
)


def _journey(t: Tables, name: str) -> DataFrame:
    return j.report_of(j.daily_journeys(j.marks(t.events), JOURNEYS), name)


@registered
def journey_overview(t: Tables) -> DataFrame:
    return _journey(t, "overview")


@registered
def journey_new_user(t: Tables) -> DataFrame:
    return _journey(t, "new_user_onboarding")


@registered
def journey_total_user(t: Tables) -> DataFrame:
    return _journey(t, "total_user_onboarding")


@registered
def journey_scroll(t: Tables) -> DataFrame:
    return j.deepest_scroll(j.user_day_state(t.events), report_day(None))


def _kept_state(t: Tables) -> DataFrame:
    """State of day shards: the first days are stored, then the others come and an early one is written anew."""
    spark = t.events.sparkSession
    folder = shared.new_path(spark, "state-query")
    day, odd = F.col("event_date"), F.pmod(F.hash("event_id"), F.lit(2)) == 1

    def write(rows: DataFrame) -> None:
        shards = rows.withColumn("shard", day).hint("rebalance", "shard")
        shards.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/events")

    write(t.events.where((day < "20240120") & ((day != "20240105") | odd)))
    state.bring_up_to_date(spark, f"{folder}/events/shard=", f"{folder}/state")
    write(t.events.where((day >= "20240120") | (day == "20240105")))
    state.bring_up_to_date(spark, f"{folder}/events/shard=", f"{folder}/state")
    return state.scan_state(spark, f"{folder}/state")


@registered
def reuse_snapshot(t: Tables) -> DataFrame:
    """The same two reports, the second from what the first one stored."""
    spark = t.events.sparkSession
    kept = ff.Snapshots(spark, shared.new_path(spark, "snapshots"))
    goals, sources = (kept.read(_goal_rows(t), {"events": "events"}) for _ in range(2))
    wide = ff.goal_categories(goals, tiebreak=TIEBREAK), ff.goal_sources(sources)
    long = (
        frame.unpivot([], list(columns.values()), "name", "pct")
        .where("pct IS NOT NULL")
        .select(F.lit(report).alias("report"), F.element_at(F.create_map(*(F.lit(x) for item, name in columns.items() for x in (name, item))), F.col("name")).alias("item"), "pct")
        for frame, report, columns in zip(wide, ("goals", "sources"), (r.GOAL_COLUMNS, r.SOURCE_COLUMNS), strict=True)
    )
    return next(long).unionByName(next(long))


def _long(report: DataFrame, name: str) -> DataFrame:
    columns = [c for c in report.columns if c != "dates"]
    numbers = report.select("dates", *(F.col(c).cast("double") for c in columns))
    return numbers.unpivot(["dates"], columns, "name", "value").where("value IS NOT NULL").withColumn("report", F.lit(name))


@registered
def state_reports(t: Tables) -> DataFrame:
    spark, path = t.events.sparkSession, shared.new_path(t.events.sparkSession, "daily")
    j.daily_journeys(_kept_state(t), JOURNEYS).write.parquet(path)  # a row a day, from one pass for all three
    daily = spark.read.parquet(path)
    found = [_long(j.report_of(daily, name), name) for name in j.REPORTS]
    return found[0].unionByName(found[1]).unionByName(found[2])


@registered
def state_scroll(t: Tables) -> DataFrame:
    return j.scroll_depth(_kept_state(t), t.web_user_data, t.new_user)


# --- only what is there, and what can be asked for --------------------------------


@registered
def report_explore_present(t: Tables) -> DataFrame:
    return ff.explore_journey_long(t.events)


@registered
def report_goals_present(t: Tables) -> DataFrame:
    return ff.goal_categories_long(_goal_rows(t), tiebreak=TIEBREAK)


@registered
def report_sources_present(t: Tables) -> DataFrame:
    return ff.goal_sources_long(_goal_rows(t), ff.FilterSpec(gender=["female"], start=EARLY))


@registered
def checked_goals(t: Tables) -> DataFrame:
    """The counts that a run of both goal reports hands over, beside the users it found."""
    both, check = ff.checked_goal_reports(_goal_rows(t), ff.FilterSpec(app_version=["1.0.0", "1.1.0"], end=LATE), ff.FilterSpec(country=["nowhere"]), TIEBREAK)
    row = both.first()
    counts = check.counts() | {"users": row["goals"]["total_users"] if row["goals"] else 0, "warnings": len(check.warnings())}
    return t.events.sparkSession.createDataFrame(list(counts.items()), "name string, n bigint")


@registered
def options_overview(t: Tables) -> DataFrame:
    return ff.report_options("overview", t)


@registered
def options_new_user(t: Tables) -> DataFrame:
    return ff.report_options("new_user_onboarding", t)


@registered
def options_total_user(t: Tables) -> DataFrame:
    return ff.report_options("total_user_onboarding", t)


@registered
def options_explore(t: Tables) -> DataFrame:
    return ff.report_options("explore_journey", t)


@registered
def options_scroll(t: Tables) -> DataFrame:
    return ff.report_options("scroll_depth", t)


@registered
def options_web(t: Tables) -> DataFrame:
    return ff.report_options("web_events", t)


@registered
def options_goals(t: Tables) -> DataFrame:
    return ff.report_options("goal_categories", t)


@registered
def web_rows_by_user(t: Tables) -> DataFrame:
    """Visits with user types from tables that are stored by user."""
    spark, path = t.events.sparkSession, shared.new_path(t.events.sparkSession, "by-user")
    name = f"by_user_{path[-32:]}"
    by_user.store_visits(t.web_user_data, f"{name}_visits", BUCKETS, f"{path}/visits")
    by_user.store_first_seen(t.new_user, f"{name}_seen", BUCKETS, f"{path}/seen")
    return by_user.stored_web_rows(spark, f"{name}_visits", f"{name}_seen")


@registered
def run_sql_bound(t: Tables) -> DataFrame:
    text = (
        "SELECT event_name, count(*) AS n, min(:note) AS note FROM {events} WHERE event_date >= date_format(:since, 'yyyyMMdd') "
        "AND event_name <> :other AND array_contains(:platforms, platform) GROUP BY event_name"
    )
    args = {"since": EARLY, "other": "it's {not} :there", "note": "l'été -- \"a\"", "platforms": F.array(F.lit("ANDROID"), F.lit("IOS"))}
    return ff.run_sql(t, text, args)


def queries() -> dict[str, Query]:
    """The registered queries over a test-data folder."""
    return {name: _over_folder(build) for name, build in BUILDERS.items()}
