"""Edge cases of each report and operator, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import footfall as ff
from footfall import vocabulary as v
from footfall.functions import classify
from footfall.functions.dates import duration_seconds, report_day
from footfall.functions.numbers import percent, round2, show_count, show_percent
from footfall.functions.params import explode_params, param_int, param_string
from footfall.functions.rules import rule_label, rule_number
from footfall.operators.filters import of_events
from footfall.operators.first_seen import as_user_types, with_first_seen
from footfall.operators.goals import latest_goal
from footfall.operators.scroll import max_scroll
from footfall.operators.user_days import pivot_users
from footfall.plans import extracts as x
from footfall.plans import reports as r
from tests.rows import dicts, event, events, first_seen, visit, web

COUNT, SCREEN = v.PREVIOUS_FIRST_OPEN_COUNT, v.SCREEN_NAME


def one(frame):
    rows = dicts(frame)
    assert len(rows) == 1
    return rows[0]


# --- keyed lookups ------------------------------------------------------------


def test_lookup_takes_first_match_and_null_without_one(spark):
    given = events(spark, event("e", params=[("k", "x"), ("k", "y")]), event("e", user="b"), event("e", user="c", params=None))
    values = {row["user_pseudo_id"]: row["got"] for row in given.select("user_pseudo_id", param_string("k").alias("got")).collect()}
    assert values == {"a": "x", "b": None, "c": None}


def test_strict_lookup_fails_on_repeated_key(spark):
    given = events(spark, event("e", params=[("k", 1), ("k", 2)]))
    with pytest.raises(PySparkException, match="more than once"):
        given.select(param_int("k", strict=True)).collect()
    single = events(spark, event("e", params={"k": 1}), event("e", params=None))
    assert sorted(str(row[0]) for row in single.select(param_int("k", strict=True)).collect()) == ["1", "None"]


def test_empty_params_vanish_on_explode(spark):
    given = events(spark, event("e", params={"k": 1, "l": "x"}), event("e", user="b"), event("e", user="c", params=None))
    assert explode_params(given).count() == 2
    reduced = explode_params(given, only_where=F.col("event_name") == "other")
    assert [row["user_pseudo_id"] for row in reduced.collect()] == ["a"]


def test_overview_takes_the_largest_of_repeated_counts(spark):
    given = events(spark, event("first_open", params=[("other", 1), (COUNT, 0), (COUNT, 3)]))
    row = one(x.classified_user_days(given))
    assert row["previous_first_open_count"] == 3 and row["user_type"] == "reinstall"


# --- install classes ----------------------------------------------------------


def test_missing_count_differs_between_overview_and_onboarding(spark):
    given = events(
        spark,
        event("first_open", user="absent", params={"other": 1}),
        event("first_open", user="zero", params={COUNT: 0}),
        event("first_open", user="two", params={COUNT: 2}),
        event("screen_load", user="old", params={SCREEN: "home_screen"}),
    )
    kinds = {row["user_pseudo_id"]: row["user_type"] for row in x.classified_user_days(given).collect()}
    assert kinds == {"absent": "new_user", "zero": "fresh_install", "two": "reinstall", "old": "returning_user"}
    installs = {row["user_pseudo_id"]: row["install_type"] for row in x.new_installs(given).collect()}
    assert installs == {"absent": "fresh_install", "zero": "fresh_install", "two": "reinstall"}
    assert one(ff.overview(given)) == {
        "dates": "2024-01-01",
        "total_users": 4,
        "new_users": 3,
        "returning_users": 1,
        "fresh_installs": 1,
        "reinstalls": 1,
        "users_with_custom_event": 1,
    }


def test_empty_params_missing_in_overview_but_no_event_in_total_users(spark):
    given = events(spark, event("session_start", user="a"), event("screen_load", user="b", params={SCREEN: "splash_screen"}))
    assert one(ff.overview(given))["total_users"] == 1
    row = one(ff.total_user_onboarding(given))
    assert (row["total_users"], row["no_event"], row["splash"]) == (2, 50.0, 50.0)


def test_overview_range_needs_both_ends(spark):
    given = events(spark, *(event("e", day=d, params={"k": 1}) for d in ("20240101", "20240102", "20240103")))
    assert ff.overview(given, ff.FilterSpec(start=dt.date(2024, 1, 2))).count() == 3
    assert ff.overview(given, ff.FilterSpec(start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 2))).count() == 1


def test_only_android_counts(spark):
    given = events(spark, event("e", params={"k": 1}, platform="IOS"), event("e", params={"k": 1}, platform=None))
    assert ff.overview(given).count() == 0


# --- onboarding ---------------------------------------------------------------


def test_unlabelled_pairs_count_in_total_only(spark):
    given = events(
        spark,
        event("first_open", user="a"),
        event("view_click", user="a", params={SCREEN: "home_screen"}),
        event("first_open", user="b"),
    )
    row = one(ff.new_user_onboarding(given))
    assert row.pop("total_users") == 2
    assert row.pop("no_custom_event") == 50.0
    row.pop("dates")
    assert set(row.values()) == {0.0}
    labels = {(e["user_pseudo_id"], e["descriptive_event"]) for e in x.new_user_rows(given).collect()}
    assert labels == {("a", "Other: view_click - home_screen"), ("b", "No custom event")}


def test_steps_of_another_day_do_not_count(spark):
    given = events(
        spark,
        event("first_open", user="a", day="20240101"),
        event("screen_load", user="a", day="20240102", params={SCREEN: "splash_screen"}),
    )
    row = one(ff.new_user_onboarding(given))
    assert (row["dates"], row["splash"], row["no_custom_event"]) == ("2024-01-01", 0.0, 100.0)


def test_filter_on_steps_drops_users_without_a_step(spark):
    given = events(
        spark,
        event("first_open", user="a"),
        event("screen_load", user="a", params={SCREEN: "splash_screen"}, version="1.0"),
        event("screen_load", user="a", params={SCREEN: "login_screen"}, version="2.0"),
        event("first_open", user="b", version="1.0"),
    )
    row = one(ff.new_user_onboarding(given, ff.FilterSpec(app_version=["1.0"])))
    assert (row["total_users"], row["splash"], row["login_screen_load"], row["no_custom_event"]) == (1, 100.0, 0.0, 0.0)


def test_unknown_new_user_keeps_the_day_with_empty_shares(spark):
    given = events(
        spark,
        event("first_open", user=None),
        event("screen_load", user=None, params={SCREEN: "splash_screen"}),
    )
    row = one(ff.new_user_onboarding(given))
    assert (row["total_users"], row["splash"], row["no_custom_event"]) == (0, None, None)
    assert ff.new_user_onboarding(given, ff.FilterSpec(country=["IN"])).count() == 0
    total = one(ff.total_user_onboarding(given))
    assert (total["total_users"], total["splash"]) == (0, 0.0)


def test_one_user_of_both_install_types_counts_once(spark):
    given = events(spark, event("first_open", params={COUNT: 0}), event("first_open", params={COUNT: 2}))
    assert one(ff.new_user_onboarding(given))["total_users"] == 1
    for kind in (v.FRESH_INSTALL, v.REINSTALL):
        assert one(ff.new_user_onboarding(given, ff.FilterSpec(install_type=[kind])))["total_users"] == 1


def test_joined_rows_keep_their_multiplicity(spark):
    load = event("screen_load", params={SCREEN: "splash_screen"})
    given = events(spark, event("first_open"), event("first_open"), load, load, load)
    assert one(x.new_user_rows(given))["n_rows"] == 6


def test_missing_event_or_screen_in_total_users(spark):
    given = events(
        spark,
        event(None, user="a", params={SCREEN: "splash_screen"}),
        event("session_start", user="b", params={"k": 1}),
        event("session_start", user="c", params={SCREEN: "splash_screen"}),
        event("screen_load", user="d", params={SCREEN: "splash_screen"}),
    )
    labels = {e["user_pseudo_id"]: e["app_event"] for e in x.total_user_rows(given).collect()}
    assert labels == {"a": "No custom event", "b": None, "c": "Other: session_start - splash_screen", "d": "Splash"}
    row = one(ff.total_user_onboarding(given))
    assert (row["total_users"], row["no_custom_event"], row["no_event"], row["splash"]) == (4, 25.0, 25.0, 25.0)


def test_missing_policies(spark):
    given = events(spark, event("screen_load", params={SCREEN: "splash_screen"}))
    zero = ff.total_user_onboarding(given)
    assert len(zero.columns) == 22 and one(zero)["no_event"] == 0.0
    assert one(ff.total_user_onboarding(given, missing="null"))["login_screen_load"] == 0.0  # percent of nothing fills with 0
    assert ff.total_user_onboarding(given, missing="omit").columns == ["dates", "total_users", "splash"]


# --- explore ------------------------------------------------------------------

DAY_MS = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def explore_event(name="screen_load", user="1", opened=DAY_MS, day="20240101", screen="home_screen", props=(), **params):
    properties = [(v.USER_ID, user), (v.FIRST_OPEN_TIME, opened), *dict(props).items()]
    return event(
        name, day=day, params={SCREEN: screen, **params}, props=[(k, x) for k, x in properties if x is not None]
    )


def test_first_day_uses_utc_and_survives_odd_times(spark):
    given = events(
        spark,
        explore_event(user="first ms", opened=DAY_MS),
        explore_event(user="last ms", opened=DAY_MS + 86_399_999),
        explore_event(user="before", opened=DAY_MS - 1),
        explore_event(user="after", opened=DAY_MS + 86_400_000),
        explore_event(user="huge", opened=2**62),
        explore_event(user="negative", opened=-(2**62)),
        explore_event(user="absent", opened=None),
        explore_event(user="1969", opened=-1, day="19691231"),
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        users = {row["user_id"] for row in x.explore_rows(given).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert users == {"first ms", "last ms", "1969"}


def test_only_listed_explore_actions_of_logged_in_users(spark):
    given = events(
        spark,
        explore_event(user=None),
        explore_event(user="a"),
        explore_event("view_click", user="b", screen="home_screen", view_id="other"),
        explore_event("view_click", user="c", screen="home_screen"),
        explore_event("view_click", user="d", screen="home_screen", view_id="beesi_kya_hai"),
        explore_event("screen_load", user="e", screen="login_screen"),
    )
    actions = {row["user_id"]: row["actions"] for row in x.explore_rows(given).collect()}
    assert actions == {"a": "User landed on homepage", "d": "User click on beesi kya hai"}


def test_longest_view_decides_the_bucket(spark):
    given = events(
        spark,
        *(explore_event("pause_player", user="a", screen="beesi_kya_hai", duration=d) for d in ("1:30", "0:20")),
        explore_event("pause_player", user="b", screen="beesi_kya_hai", duration="0:00"),
        explore_event("pause_player", user="c", screen="beesi_kya_hai", duration="broken"),
        explore_event("pause_player", user="d", screen="beesi_kya_hai", duration="2:01"),
    )
    row = one(ff.explore_journey(given))
    assert row["user_watched_the_video_for_61_120_seconds"] == 25.0
    assert row["user_watched_the_video_for_more_than_120_seconds"] == 25.0
    assert row["user_didnt_watch_the_video"] == 50.0
    with pytest.raises(PySparkException):
        ff.explore_journey(given, missing="zero", strict_duration=True).collect()


def test_explore_omits_absent_actions_but_no_bucket(spark):
    shown = ff.explore_journey(events(spark, explore_event()))
    assert shown.columns == ["dates", "total_users", "user_landed_on_homepage", *map(v.snake, v.WATCH_LABELS)]


def test_explore_defaults_are_filterable(spark):
    given = events(spark, explore_event(user="a"), explore_event(user="b", props={v.USER_GENDER: "male"}))
    assert one(ff.explore_journey(given, ff.FilterSpec(gender=["NA"])))["total_users"] == 1


@pytest.mark.parametrize(
    "text, seconds",
    [("0:00", 0), ("1:05", 65), ("10:00", 600), (None, 0), ("", 0), ("7", 0), ("a:b", 0), ("1:2:3", 62), ("9223372036854775807:1", 0)],
)
def test_duration(spark, text, seconds):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(duration_seconds(F.col("t"))).first()[0] == seconds


@pytest.mark.parametrize("seconds", [0, 1, 10, 11, 30, 31, 60, 61, 120, 121, -5])
def test_watch_bucket_borders(spark, seconds):
    expected = next(
        (label for label, low, high in v.WATCH_BUCKETS if seconds > low and (high is None or seconds <= high)),
        v.NOT_WATCHED if seconds == 0 else None,
    )
    assert spark.range(1).select(classify.watch_bucket(F.lit(seconds))).first()[0] == expected


# --- web ----------------------------------------------------------------------


def test_user_without_id_counts_as_one(spark):
    given = web(spark, visit("2024-01-01", user=None), visit("2024-01-01", user=None), visit("2024-01-01", user="a"))
    row = one(ff.web_events(given, first_seen(spark)))
    assert row["home_page_view"] == 2 and row["open_app_nudge_1"] is None


def test_absent_web_event_is_null_and_empty_day_zero(spark):
    given = web(spark, visit("2024-01-01"), visit("2024-01-02", name="Open_App_Nudge_1"), visit("2024-01-03", name="other"))
    rows = {row["dates"]: row for row in dicts(ff.web_events(given, first_seen(spark)))}
    assert set(rows) == {"2024-01-01", "2024-01-02"}
    assert rows["2024-01-01"]["open_app_nudge_1"] == 0 and rows["2024-01-01"]["open_app_nudge_2"] is None


def test_first_seen_may_make_a_user_both_new_and_returning(spark):
    seen = first_seen(spark, ("w", "2024-01-01"), ("w", "2024-01-02"), ("w", "2024-01-02"), ("x", None))
    given = web(spark, visit("2024-01-02"), visit("2024-01-02"), visit("2024-01-02", user="x"), visit(None, user="w"), visit("2024-01-02", user=None))
    rows = {(row["User_ID"], row["Dates"], row["User_Type"]): row["n_rows"] for row in x.web_rows(given, seen, dt.date(2024, 1, 9)).collect()}
    day = dt.date(2024, 1, 2)
    assert rows == {
        ("w", day, "New User"): 4,
        ("w", day, "Returning User"): 2,
        ("w", dt.date(2024, 1, 9), "Returning User"): 3,
        ("x", day, "Returning User"): 1,
        (None, day, "Returning User"): 1,
    }


def test_row_without_day_is_never_new_even_on_the_report_day(spark):
    seen = first_seen(spark, ("w", "2024-01-09"))
    given = web(spark, visit(None))
    for kind, n in ((v.WEB_NEW_USER, 0), (v.WEB_RETURNING_USER, 1)):
        frame = ff.web_events(given, seen, ff.FilterSpec(user_type=[kind]), report_date=dt.date(2024, 1, 9))
        assert frame.count() == n


def test_report_date_books_rows_without_a_day(spark):
    given = web(spark, visit(None), visit("2024-01-01"))
    booked = dt.date(2024, 1, 5)
    days = [row["dates"] for row in ff.web_events(given, first_seen(spark), report_date=booked).collect()]
    assert days == ["2024-01-05", "2024-01-01"]
    late = ff.FilterSpec(start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 9))
    assert [row["dates"] for row in ff.web_events(given, first_seen(spark), late, booked).collect()] == ["2024-01-05"]
    assert one(ff.web_events(given, first_seen(spark), ff.FilterSpec(start=dt.date(2024, 1, 2))))["home_page_view"] == 1


def test_unknown_selects_missing_dimension(spark):
    given = web(spark, visit("2024-01-01", user="a", device="mobile"), visit("2024-01-01", user="b"))
    assert one(ff.web_events(given, first_seen(spark), ff.FilterSpec(device=["Unknown"])))["home_page_view"] == 1
    both = ff.FilterSpec(device=["Unknown", "mobile"])
    assert one(ff.web_events(given, first_seen(spark), both))["home_page_view"] == 2


def test_both_user_types_mean_no_filter(spark):
    given = web(spark, visit("2024-01-01"), visit("2024-01-01", user=None))
    spec = ff.FilterSpec(user_type=[v.WEB_NEW_USER, v.WEB_RETURNING_USER])
    assert one(ff.web_events(given, first_seen(spark, ("w", "2024-01-01")), spec))["home_page_view"] == 2


# --- scroll -------------------------------------------------------------------


def scrolled(user, percent_, day="20240101", platform="WEB", name="Scroll"):
    return event(name, user=user, day=day, platform=platform, params={v.PERCENT_SCROLLED: percent_} if percent_ is not None else {})


def test_scroll_counts_by_day_and_leaves_unreached_thresholds_empty(spark):
    visits = web(spark, *(visit("2024-01-01", user=u) for u in "abcd"), visit("2024-01-01", user=None))
    depth = events(
        spark,
        scrolled("a", 40),
        scrolled("a", 90, name="scroll"),
        scrolled("b", None),
        scrolled("c", 80, day="20240102"),
        scrolled("d", 20, platform="IOS"),
        scrolled("d", 60),
        scrolled("stranger", 100),
    )
    assert one(ff.scroll_depth(depth, visits, first_seen(spark))) == {
        "dates": "2024-01-01",
        "total_users": 4,
        "interacted_users": 2,
        "bounce_pct": 50.0,
        "scrolled_20_pct": 50.0,
        "scrolled_40_pct": 50.0,
        "scrolled_60_pct": 25.0,
        "scrolled_80_pct": None,
        "scrolled_100_pct": None,
    }


def test_day_of_unknown_users_has_empty_bounce(spark):
    row = one(ff.scroll_depth(events(spark), web(spark, visit("2024-01-01", user=None)), first_seen(spark)))
    assert (row["total_users"], row["interacted_users"], row["bounce_pct"]) == (0, 0, None)


def test_scroll_without_day_is_booked(spark):
    booked = dt.date(2024, 1, 5)
    depth = events(spark, scrolled("w", 60, day=None), scrolled("w", 20, day="20240105"))
    assert one(max_scroll(depth, report_day(booked)))["max_scroll_percent"] == 60
    spec = ff.FilterSpec(start=booked, end=booked)
    row = one(ff.scroll_depth(depth, web(spark, visit(None)), first_seen(spark), spec, booked))
    assert (row["dates"], row["scrolled_60_pct"]) == ("2024-01-05", 100.0)


def test_user_of_both_types_counts_once_in_scroll(spark):
    seen = first_seen(spark, ("w", "2024-01-01"), ("w", "2024-01-02"))
    visits = web(spark, visit("2024-01-01"))
    assert x.scroll_rows(events(spark), visits, seen).count() == 2
    for kinds in ([], [v.WEB_NEW_USER], [v.WEB_RETURNING_USER], [v.WEB_NEW_USER, v.WEB_RETURNING_USER]):
        assert one(ff.scroll_depth(events(spark), visits, seen, ff.FilterSpec(user_type=kinds)))["total_users"] == 1


def test_event_names_are_case_sensitive(spark):
    assert of_events(events(spark, event("scroll"), event("Scroll")), v.SCROLL).count() == 1


# --- goals --------------------------------------------------------------------


def goal(user, text, day="20240101", custom=0, name="view_click", screen=v.GOAL_SCREEN, source=None, **more):
    params = {v.USER_ID: user, SCREEN: screen, v.GOAL_SELECTED: text, v.IS_CUSTOM_GOAL: custom, v.SOURCE: source}
    return event(name, day=day, params={k: x for k, x in params.items() if x is not None}, **more)


@pytest.mark.parametrize(
    "text, custom, category",
    [
        ("Scarf", 0, "Car"),
        ("my CAR and bike", 0, "Bike"),
        ("Buy iphone", None, "iPhone"),
        ("host party", 0, "Host Party"),
        ("Car", 1, "Others"),
        ("Wedding", 0, "Others"),
        ("", None, "Others"),
    ],
)
def test_goal_category(spark, text, custom, category):
    frame = spark.createDataFrame([(custom, text)], "c bigint, t string")
    assert frame.select(classify.goal_category(F.col("c"), F.col("t"))).first()[0] == category


def test_latest_goal_wins_and_masks_apply(spark):
    given = events(
        spark,
        goal("1", "Car", day="20240103"),
        goal("1", "Bike", day="20240101"),
        goal("2", "Bike"),
        goal("3", "Laptop", screen="home_screen"),
        goal("4", "Laptop", name="screen_load"),
        goal("5", None),
        goal(None, "Laptop"),
    )
    rows = ff.goal_rows(given)
    assert {row["user_id"]: row["goal_category"] for row in r.latest_goals(rows).collect()} == {"1": "Car", "2": "Bike"}
    row = one(ff.goal_categories(rows))
    assert (row["total_users"], row["car"], row["bike"], row["laptop"]) == (2, 50.0, 50.0, None)
    assert ff.goal_categories(rows, missing="omit").columns == ["total_users", "bike", "car"]


def test_latest_goal_tie_is_settled(spark):
    clicks = spark.createDataFrame(
        [("1", "20240101", 7, "Bike", 0), ("1", "20240101", 3, "Car", 0)],
        "user_id string, event_date string, id bigint, goal_selected string, is_custom_goal bigint",
    )
    assert one(latest_goal(clicks, ["id"]))["goal_selected"] == "Bike"
    assert one(latest_goal(clicks))["goal_selected"] == "Car"


def test_no_goals_no_row(spark):
    rows = ff.goal_rows(events(spark, goal("1", None)))
    assert ff.goal_categories(rows).count() == 0
    assert ff.goal_categories(rows, missing="omit").columns == ["total_users"]
    assert ff.goal_sources(rows).count() == 0


def test_custom_goals(spark):
    rows = ff.goal_rows(events(spark, goal("1", "Wedding"), goal("2", "Wedding"), goal("3", "Car", custom=1), goal("4", "Car")))
    assert sorted(row[0] for row in ff.custom_goals(rows).collect()) == ["Car", "Wedding"]


def test_source_share_may_pass_100(spark):
    given = events(
        spark,
        goal("1", "Car", source="set_now_home_screen"),
        goal("2", None, source="create_beesi_home_screen"),
        goal("3", None, source="somewhere"),
        goal("4", None, source="edit_goal_settings_screen"),
        goal("4", None, source="edit_goal_settings_screen"),
    )
    assert one(ff.goal_sources(ff.goal_rows(given))) == {
        "total_logged_in_users": 4,
        "users_who_set_goals": 1,
        "group_screen": None,
        "home_screen": 200.0,
        "reward_screen_flow": None,
        "settings_screen": 100.0,
    }


def test_source_share_without_goals_is_empty(spark):
    row = one(ff.goal_sources(ff.goal_rows(events(spark, goal("1", None, source="set_now_home_screen")))))
    assert (row["users_who_set_goals"], row["home_screen"]) == (0, None)
    assert ff.goal_sources(ff.goal_rows(events(spark, goal("1", "Car", source="set_now_home_screen"))), missing="omit").columns == [
        "total_logged_in_users",
        "users_who_set_goals",
        "home_screen",
    ]


# --- numbers, rules, filters --------------------------------------------------


@pytest.mark.parametrize("a, b, expected", [(1, 32, 3.12), (3, 32, 9.38), (1, 3, 33.33), (1, 800, 0.12)])
def test_halves_round_to_even(spark, a, b, expected):
    frame = spark.createDataFrame([(a, b)], "a bigint, b bigint")
    assert frame.select(round2(percent(F.col("a"), F.col("b")))).first()[0] == expected


def test_percent_of_zero(spark):
    frame = spark.createDataFrame([(0, 0)], "a bigint, b bigint")
    assert frame.select(percent(F.col("a"), F.col("b")), percent(F.col("a"), F.col("b"), "zero")).first() == (None, 0.0)


def test_number_display(spark):
    frame = spark.createDataFrame([(1234567, 1234.565)], "n bigint, p double")
    shown = frame.select(show_count(F.col("n")), show_count(F.col("n"), thousands=False), show_percent(F.col("p"))).first()
    assert tuple(shown) == ("1,234,567", "1234567", f"{1234.565:.2f}%")


def test_rules_meet_at_most_one(spark):
    frame = spark.createDataFrame([("e", "s", None), ("e", "s", "x"), ("e", "t", "x"), (None, None, None)], "e string, s string, w string")
    rules = [v.Rule("e", "s", None, "any"), v.Rule("e", "t", "x", "it's viewed")]
    columns = F.col("e"), F.col("s"), F.col("w")
    assert [row[0] for row in frame.select(rule_number(rules, *columns)).collect()] == [1, 1, 2, 0]
    assert [row[0] for row in frame.select(rule_label(rules, *columns)).collect()] == ["any", "any", "it's viewed", None]
    with pytest.raises(ValueError):
        rule_number(rules, *columns[:2])
    with pytest.raises(ValueError):
        rule_number([*rules, v.Rule("e", "t", None, "clash")], *columns)


def test_long_label_lists(spark):
    labels = [f"label {i}" for i in range(150)]
    rows = [("d", f"u{i % 7}", labels[i]) for i in range(150)] + [("d", None, labels[0]), ("d", "u9", None), ("e", "u9", None)]
    frame = spark.createDataFrame(rows, "d string, u string, l string")
    row = one(pivot_users(frame, "d", "u", "l", labels, total="total"))
    assert row["total"] == 8 and all(row[label] == 1 for label in labels)


def test_filters_of_another_report_are_refused(spark):
    with pytest.raises(ValueError, match="device"):
        ff.total_user_onboarding(events(spark), ff.FilterSpec(device=["mobile"]))


def test_selection_is_a_list_not_a_text():
    with pytest.raises(TypeError, match="country"):
        ff.FilterSpec(country="IN")


def test_null_never_matches_a_selection_and_empty_selects_all(spark):
    given = events(spark, event("e", user="a", country="IN"), event("e", user="b"))
    assert one(ff.total_user_onboarding(given, ff.FilterSpec(country=["IN"])))["total_users"] == 1
    assert one(ff.total_user_onboarding(given, ff.FilterSpec(country=[])))["total_users"] == 2


def test_first_seen_spreads_rows_without_user(spark):
    rows = web(spark, *(visit("2024-01-01", user=None, city=str(i)) for i in range(50)))
    matched = with_first_seen(rows, first_seen(spark, ("w", "2024-01-01"), (None, "2024-01-01")))
    assert {(row["User_Type"], row["n_rows"]) for row in as_user_types(matched).collect()} == {("Returning User", 1)}
    assert as_user_types(matched).count() == 50
