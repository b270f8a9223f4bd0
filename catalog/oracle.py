"""DuckDB SQL for every registered query.

The SQL reads the plain ``events`` table and never builds nested arrays, joins
where the library aggregates, and counts with ``count(DISTINCT ...)`` where the
library counts user-days. Names and lists are those of ``catalog.expected``, so the
two sides share neither method nor values.
"""

from __future__ import annotations

from collections.abc import Iterable

from catalog import expected as v
from catalog.expected import snake


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listed(values: Iterable[str | None]) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]"


def among(values: Iterable[str]) -> str:
    return "(" + ", ".join(q(x) for x in values) + ")"


def rule_case(rules: Iterable[v.Rule], otherwise: str) -> str:
    lines = []
    for rule in rules:
        test = f"event_name = {q(rule.event)} AND screen_name = {q(rule.screen)}"
        test += f" AND view_id = {q(rule.view)}" if rule.view else ""
        lines.append(f"WHEN {test} THEN {q(rule.label)}")
    return "CASE " + " ".join(lines) + f" {otherwise} END"


ONBOARDING_CASE = rule_case(
    v.ONBOARDING_RULES,
    "WHEN event_name IS NULL THEN 'No custom event' ELSE 'Other: ' || event_name || ' - ' || screen_name",
)
EXPLORE_CASE = rule_case(v.EXPLORE_RULES, "ELSE NULL")
GOAL_CASE = (
    "CASE WHEN is_custom_goal = 1 THEN 'Others' "
    + " ".join(f"WHEN contains(lower(goal_selected), {q(c.lower())}) THEN {q(c)}" for c in v.GOAL_CATEGORIES)
    + " ELSE 'Others' END"
)
SOURCE_CASE = (
    "CASE "
    + " ".join(f"WHEN sources IN {among(members)} THEN {q(group)}" for group, members in v.SOURCE_GROUPS.items())
    + " END"
)
DURATION = (
    "coalesce(CAST(split_part(duration, ':', 1) AS BIGINT) * 60 + CAST(split_part(duration, ':', 2) AS BIGINT), 0)"
)
PERSON_AND_PLACE = ("os_version", "app_version", "country", "region", "city", "gender", "age", "profession")
DIMS = "os_version, app_version, country, region, city"

BASE = rf"""
raw AS (
  SELECT event_id AS e, ts, user_id AS u, event_type AS t,
         CAST(regexp_extract(props, '\d+') AS BIGINT) AS k
  FROM events
),
named AS (
  SELECT *, CASE
    WHEN t = 'signup' AND k % 4 = 0 THEN 'first_open'
    WHEN t IN ('signup', 'view') THEN 'screen_load'
    WHEN t = 'click' THEN 'view_click'
    WHEN t = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'play_player' ELSE 'pause_player' END
    WHEN t = 'error' THEN CASE WHEN k % 2 = 0 THEN 'Scroll' ELSE 'app_exception' END
  END AS event_name
  FROM raw
),
screened AS (
  SELECT *, CASE
    WHEN event_name IN ('screen_load', 'view_click') THEN {listed(v.SCREENS)}[(e * 7 + k) % 13 + 1]
    WHEN event_name IN ('play_player', 'pause_player') THEN 'beesi_kya_hai'
  END AS screen_name
  FROM named
),
flat AS (
  SELECT e AS event_id, strftime(ts, '%Y%m%d') AS event_date, 'u' || u AS user_pseudo_id, event_name,
    CASE WHEN e % 10 < 8 THEN 'ANDROID' WHEN e % 10 = 8 THEN 'IOS' ELSE 'WEB' END AS platform,
    screen_name,
    CASE WHEN event_name = 'view_click' THEN CASE screen_name
      WHEN 'home_screen' THEN ['kyun_karni_hai_beesi', 'beesi_kya_hai', 'other'][k % 3 + 1]
      WHEN 'kyun_karni_hai_beesi' THEN ['cool', 'back_button', 'other'][k % 3 + 1]
      WHEN 'beesi_kya_hai' THEN ['back_button', 'create_beesi_group', 'other'][k % 3 + 1]
    END END AS view_id,
    CASE WHEN event_name = 'pause_player' THEN
      CASE WHEN k < 5 THEN '0:00' ELSE (k * 2) // 60 || ':' || lpad(CAST((k * 2) % 60 AS VARCHAR), 2, '0') END
    END AS duration,
    CASE WHEN event_name = 'Scroll' AND k % 20 <> 0 THEN (k // 10) * 10 + 10 END AS percent_scrolled,
    CASE WHEN event_name = 'first_open' AND (k // 4) % 3 <> 0 THEN (k // 4) % 3 - 1 END
      AS previous_first_open_count,
    CASE WHEN u % 5 <> 0 THEN CAST(u AS VARCHAR) END AS user_id,
    CASE WHEN u % 7 <> 0 THEN 'p' || u END AS property_user_id,
    CASE WHEN event_name = 'view_click' AND screen_name = 'set_goal_bottomsheet'
      THEN {listed(v.GOALS)}[k % 16 + 1] END AS goal_selected,
    CASE WHEN event_name = 'view_click' AND screen_name = 'set_goal_bottomsheet' AND k % 13 <> 0
      THEN CAST(k % 11 = 0 AS BIGINT) END AS is_custom_goal,
    CASE WHEN event_name IN ('screen_load', 'view_click') AND e % 2 = 0
      THEN {listed(v.SOURCES)}[(e // 2) % 8 + 1] END AS sources,
    CASE WHEN e % 17 <> 0 THEN epoch_us(ts) // 1000 - (e % 3) * 86400000 END AS first_open_time,
    ['male', 'female', NULL][u % 3 + 1] AS gender,
    ['18-24', '25-34', '35-44', NULL][u % 4 + 1] AS age,
    [NULL, 'student', 'salaried', 'self_employed', NULL][u % 5 + 1] AS profession,
    ['IN', 'US', '', NULL][u % 4 + 1] AS country,
    CASE WHEN u % 6 <> 5 THEN 'R' || (u % 6) END AS region,
    'C' || (u % 7) AS city,
    ['1.0.0', '1.1.0', '2.0.0'][(u + e // 3) % 3 + 1] AS app_version,
    'Android ' || (10 + u % 5) AS os_version
  FROM screened
),
web AS (
  SELECT CAST(ts AS DATE) AS Dates, {listed(v.WEB_CYCLE)}[(e + k) % 10 + 1] AS Event_Name,
    ['mobile', 'desktop', NULL][e % 3 + 1] AS Device,
    ['IN', 'US', '', NULL][u % 4 + 1] AS Country,
    CASE WHEN u % 6 <> 5 THEN 'R' || (u % 6) END AS Region,
    'C' || (u % 7) AS City,
    CASE WHEN e % 97 <> 0 THEN 'u' || u END AS User_ID
  FROM raw WHERE t IN ('view', 'click', 'signup')
),
first_day AS (SELECT u, min(CAST(ts AS DATE)) AS d FROM raw GROUP BY u),
nu AS (
  SELECT 'u' || u AS User_ID, d AS Dates FROM first_day
  UNION ALL SELECT 'u' || u, CAST(d + INTERVAL 1 DAY AS DATE) FROM first_day WHERE u % 10 = 0
),
android AS (SELECT * FROM flat WHERE platform = 'ANDROID'),
user_flags AS (
  SELECT event_date, user_pseudo_id,
    max(CASE WHEN event_name = 'first_open' THEN 1 ELSE 0 END) AS had_first_open,
    max(previous_first_open_count) AS previous_first_open_count,
    max(CASE WHEN event_name IN ('screen_load', 'view_click') THEN 1 ELSE 0 END) AS custom_event
  FROM android
  WHERE coalesce(screen_name, view_id, duration, CAST(percent_scrolled AS VARCHAR),
    CAST(previous_first_open_count AS VARCHAR), user_id, goal_selected, sources) IS NOT NULL
  GROUP BY 1, 2
),
user_types AS (
  SELECT *, CASE
    WHEN had_first_open = 1 AND previous_first_open_count = 0 THEN 'fresh_install'
    WHEN had_first_open = 1 AND previous_first_open_count > 0 THEN 'reinstall'
    WHEN had_first_open = 1 THEN 'new_user'
    ELSE 'returning_user' END AS user_type
  FROM user_flags
),
installs AS (
  SELECT event_date, user_pseudo_id,
    CASE WHEN previous_first_open_count > 0 THEN 'reinstall' ELSE 'fresh_install' END AS install_type
  FROM android WHERE event_name = 'first_open'
),
steps AS (
  SELECT event_date, user_pseudo_id, event_name, screen_name, {DIMS} FROM android
  WHERE event_name IN ('screen_load', 'view_click') AND screen_name IN {among(v.ONBOARDING_SCREENS)}
),
joined AS (
  SELECT i.event_date, i.user_pseudo_id, i.install_type, s.event_name, s.screen_name,
    s.os_version, s.app_version, s.country, s.region, s.city
  FROM installs i LEFT JOIN steps s
    ON i.user_pseudo_id = s.user_pseudo_id AND i.event_date = s.event_date
),
new_rows AS (SELECT *, {ONBOARDING_CASE} AS label FROM joined),
total_rows AS (SELECT *, {ONBOARDING_CASE} AS label FROM android),
explore_rows AS (
  SELECT event_id, event_date, property_user_id AS user_id, coalesce(age, 'NA') AS age, coalesce(profession, 'NA') AS profession,
    coalesce(gender, 'NA') AS gender, {EXPLORE_CASE} AS actions, {DURATION} AS duration_seconds, {DIMS}
  FROM android
  WHERE property_user_id IS NOT NULL AND strptime(event_date, '%Y%m%d') = date_trunc('day', epoch_ms(first_open_time))
    AND {EXPLORE_CASE} IS NOT NULL
),
web_listed AS (SELECT * FROM web WHERE Event_Name IN {among(v.WEB_EVENTS)}),
web_typed AS (
  SELECT w.Dates, w.Event_Name, coalesce(w.Device, 'Unknown') AS Device, coalesce(w.Country, 'Unknown') AS Country,
    coalesce(w.Region, 'Unknown') AS Region, coalesce(w.City, 'Unknown') AS City, w.User_ID,
    CASE WHEN w.Dates = n.Dates THEN 'New User' ELSE 'Returning User' END AS User_Type
  FROM web_listed w LEFT JOIN nu n ON w.User_ID = n.User_ID
),
scrolls AS (
  SELECT CAST(strptime(event_date, '%Y%m%d') AS DATE) AS Dates, user_pseudo_id AS User_ID,
    max(coalesce(percent_scrolled, 0)) AS max_scroll_percent
  FROM flat WHERE event_name = 'Scroll' GROUP BY 1, 2
),
scroll_rows AS (
  SELECT DISTINCT t.Dates, t.User_ID, t.User_Type, coalesce(s.max_scroll_percent, 0) AS max_scroll_percent
  FROM web_typed t LEFT JOIN scrolls s ON t.Dates = s.Dates AND t.User_ID = s.User_ID
),
goal_rows AS (
  SELECT event_id, event_date, user_id, gender, age, profession, event_name, screen_name, sources,
    goal_selected, is_custom_goal, {DIMS}
  FROM android WHERE user_id IS NOT NULL
)
"""


def sql(body: str, *more: str) -> str:
    return "WITH" + ",\n".join([BASE, *more]) + body


ISO = "strftime(strptime(event_date, '%Y%m%d'), '%Y-%m-%d')"
WEB_ISO = "strftime(Dates, '%Y-%m-%d')"


def users_with(condition: str, user: str = "user_pseudo_id") -> str:
    return f"count(DISTINCT CASE WHEN {condition} THEN {user} END)"


OVERVIEW_COUNTS = f"""
  count(DISTINCT user_pseudo_id) AS total_users,
  {users_with("user_type <> 'returning_user'")} AS new_users,
  {users_with("user_type = 'returning_user'")} AS returning_users,
  {users_with("user_type = 'fresh_install'")} AS fresh_installs,
  {users_with("user_type = 'reinstall'")} AS reinstalls,
  {users_with("custom_event = 1")} AS users_with_custom_event
"""


def overview(where: str = "TRUE") -> str:
    return sql(f"SELECT {ISO} AS dates, {OVERVIEW_COUNTS} FROM user_types WHERE {where} GROUP BY 1 ORDER BY 1 DESC")


def funnel(rows: str, labels: Iterable[str], where: str, zero_is: str) -> str:
    total = "count(DISTINCT user_pseudo_id)"
    shares = ", ".join(
        f"coalesce({users_with('label = ' + q(label))} / nullif({total}, 0), {zero_is}) * 100 AS {snake(label)}"
        for label in labels
    )
    return sql(f"SELECT {ISO} AS dates, {total} AS total_users, {shares} FROM {rows} WHERE {where} GROUP BY 1 ORDER BY 1 DESC")


NEW_LABELS = (*v.ONBOARDING_LABELS, v.NO_CUSTOM_EVENT)
ALL_LABELS = (*v.ONBOARDING_LABELS, v.NO_EVENT, v.NO_CUSTOM_EVENT)
LABELLED_ALL = "(SELECT * REPLACE (coalesce(label, 'No Event') AS label) FROM total_rows)"
EXPLORE_COUNTS = ", ".join(
    [
        "count(DISTINCT user_id) AS total_users",
        *(f"{users_with('actions = ' + q(label), 'user_id')} AS {snake(label)}" for label in v.EXPLORE_LABELS),
    ]
)
BUCKET_TESTS = {
    v.NOT_WATCHED: "m = 0",
    **{label: f"m > {low}" + (f" AND m <= {high}" if high else "") for label, low, high in v.WATCH_BUCKETS},
}


def explore_tables(where: str = "TRUE") -> tuple[str, ...]:
    chosen = f"chosen AS (SELECT * FROM explore_rows WHERE {where})"
    pivot = f"pivoted AS (SELECT event_date, {EXPLORE_COUNTS} FROM chosen GROUP BY 1)"
    longest = "longest AS (SELECT event_date, user_id, max(duration_seconds) AS m FROM chosen GROUP BY 1, 2)"
    counts = ", ".join(f"count(CASE WHEN {test} THEN 1 END) AS {snake(label)}" for label, test in BUCKET_TESTS.items())
    watched = f"watched AS (SELECT event_date, count(*) AS watchers, {counts} FROM longest GROUP BY 1)"
    return chosen, pivot, longest, watched


def explore(where: str = "TRUE") -> str:
    actions = ", ".join(f"{snake(label)} / total_users * 100 AS {snake(label)}" for label in v.EXPLORE_LABELS)
    watch = ", ".join(f"{snake(label)} / watchers * 100 AS {snake(label)}" for label in v.WATCH_LABELS)
    return sql(
        f"SELECT {ISO} AS dates, total_users, {actions}, {watch} "
        "FROM pivoted LEFT JOIN watched USING (event_date) ORDER BY 1 DESC",
        *explore_tables(where),
    )


SCROLL_COUNTS = ", ".join(
    [
        "count(DISTINCT User_ID) AS total_users",
        f"{users_with('max_scroll_percent > 0', 'User_ID')} AS interacted_users",
        *(f"{users_with(f'max_scroll_percent >= {t}', 'User_ID')} AS scrolled_{t}" for t in v.SCROLL_THRESHOLDS),
    ]
)


def scroll_days(where: str = "TRUE") -> str:
    return f"days AS (SELECT Dates, {SCROLL_COUNTS} FROM scroll_rows WHERE {where} GROUP BY 1)"


BOUNCE = "round_even((total_users - interacted_users) / nullif(total_users, 0) * 100, 2)"


def scrolled_pct(t: int) -> str:
    return f"round_even(nullif(scrolled_{t}, 0) / nullif(total_users, 0) * 100, 2)"


def scroll(where: str = "TRUE") -> str:
    shares = ", ".join(f"{scrolled_pct(t)} AS scrolled_{t}_pct" for t in v.SCROLL_THRESHOLDS)
    return sql(
        f"SELECT {WEB_ISO} AS dates, total_users, interacted_users, {BOUNCE} AS bounce_pct, {shares} "
        "FROM days ORDER BY 1 DESC",
        scroll_days(where),
    )


def web_cells(labels: Iterable[str]) -> str:
    return ", ".join(
        f"count(DISTINCT CASE WHEN Event_Name = {q(e)} THEN coalesce(User_ID, 'nobody') END) AS {snake(e)}" for e in labels
    )


def web_events(where: str = "TRUE", labels: Iterable[str] = v.WEB_EVENTS) -> str:
    labels = list(labels)
    cells = ", ".join(
        f"CASE WHEN max({snake(e)}) OVER () > 0 THEN {snake(e)} END AS {snake(e)}" for e in labels
    )
    return sql(
        f"SELECT {WEB_ISO} AS dates, {cells} FROM days ORDER BY 1 DESC",
        f"days AS (SELECT Dates, {web_cells(labels)} FROM web_typed WHERE {where} GROUP BY 1)",
    )


def goal_tables(where: str = "TRUE") -> tuple[str, ...]:
    clicks = (
        f"clicks AS (SELECT *, {GOAL_CASE} AS goal_category FROM goal_rows WHERE event_name = 'view_click' "
        f"AND screen_name = 'set_goal_bottomsheet' AND goal_selected IS NOT NULL AND {where})"
    )
    latest = (
        "latest AS (SELECT user_id, event_date, goal_selected, goal_category FROM clicks "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_date DESC, event_id DESC) = 1)"
    )
    counts = (
        "counts AS (SELECT goal_category, count(*) AS users, "
        "round_even(count(*) / (SELECT count(*) FROM latest) * 100, 2) AS pct FROM latest GROUP BY 1)"
    )
    return clicks, latest, counts


def goal_cells() -> str:
    return ", ".join(
        f"(SELECT pct FROM counts WHERE goal_category = {q(c)}) AS {snake(c)}" for c in (*v.GOAL_CATEGORIES, v.OTHERS)
    )


def goals(where: str = "TRUE") -> str:
    return sql(
        f"SELECT * FROM (SELECT (SELECT count(*) FROM latest) AS total_users, {goal_cells()}) WHERE total_users > 0",
        *goal_tables(where),
    )


def source_tables(where: str = "TRUE") -> tuple[str, ...]:
    chosen = f"chosen AS (SELECT *, {SOURCE_CASE} AS source_category FROM goal_rows WHERE {where})"
    totals = (
        "totals AS (SELECT count(DISTINCT user_id) AS total_logged_in_users, "
        f"{users_with('goal_selected IS NOT NULL', 'user_id')} AS users_who_set_goals FROM chosen)"
    )
    per_group = (
        "per_group AS (SELECT source_category, count(DISTINCT user_id) AS users FROM chosen "
        "WHERE source_category IS NOT NULL GROUP BY 1)"
    )
    return chosen, totals, per_group


def source_cells(value: str) -> str:
    return ", ".join(
        f"(SELECT {value} FROM per_group WHERE source_category = {q(g)}) AS {snake(g)}" for g in sorted(v.SOURCE_GROUPS)
    )


SOURCE_SHARE = "round_even(users / nullif(users_who_set_goals, 0) * 100, 2)"


def sources(where: str = "TRUE") -> str:
    return sql(
        f"SELECT total_logged_in_users, users_who_set_goals, {source_cells(SOURCE_SHARE)} FROM totals "
        "WHERE (SELECT count(*) FROM per_group) > 0",
        *source_tables(where),
    )


PARAM_COLUMNS = {
    "screen_name": ("screen_name", True),
    "view_id": ("view_id", True),
    "duration": ("duration", True),
    "beesi_user_id": ("user_id", True),
    "goal_selected": ("goal_selected", True),
    "source": ("sources", True),
    "percent_scrolled": ("percent_scrolled", False),
    "previous_first_open_count": ("previous_first_open_count", False),
    "is_custom_goal": ("is_custom_goal", False),
}
PARAMS_UNION = " UNION ALL ".join(
    f"SELECT event_id, event_name, {q(key)} AS key, "
    + (f"{c} AS string_value, CAST(NULL AS BIGINT) AS int_value" if text else f"NULL AS string_value, {c} AS int_value")
    + f" FROM flat WHERE {c} IS NOT NULL"
    for key, (c, text) in PARAM_COLUMNS.items()
)
N_PARAMS = " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c, _ in PARAM_COLUMNS.values())
N_PROPERTIES = " + ".join(
    f"CAST({c} IS NOT NULL AS BIGINT)" for c in ("property_user_id", "gender", "age", "profession", "first_open_time")
)


def options(table: str, columns: Iterable[str], extra: str = "") -> str:
    return sql(
        " UNION ".join(
            f"SELECT {q(c)} AS dimension, {c} AS option FROM {table} WHERE {c} <> ''" + extra.format(c) for c in columns
        )
    )


def page_options(table: str, day: str, columns: dict[str, str], where: str = "TRUE") -> str:
    """Bounds and options of one report; ``where`` tests a value as ``{0}``."""
    bounds = [f"SELECT '{name}' AS dimension, {f}({day}) AS option FROM {table}" for name, f in (("first_day", "min"), ("last_day", "max"))]
    values = [f"(SELECT DISTINCT {q(d)}, {c} FROM {table} WHERE {c} <> '' AND {where.format(c)})" for d, c in columns.items()]
    return sql(union_long(*bounds, *values))


def long_report(wide: str, columns: Iterable[str], always: Iterable[str]) -> str:
    """A daily report unpivoted, without the columns that are 0 on all days."""
    return (
        f"SELECT dates, list_position({listed(columns)}, \"column\") AS position, \"column\", value FROM (UNPIVOT "
        f"(SELECT dates, CAST(COLUMNS(* EXCLUDE (dates)) AS DOUBLE) FROM ({wide})) "
        "ON COLUMNS(* EXCLUDE (dates)) INTO NAME \"column\" VALUE value) "
        f"QUALIFY \"column\" IN {among(always)} OR max(value) OVER (PARTITION BY \"column\") > 0"
    )


def long_row(wide: str, order: str) -> str:
    """A one-row report unpivoted, without its NULLs."""
    return (
        f"SELECT row_number() OVER (ORDER BY {order}) AS position, \"column\", value FROM (UNPIVOT "
        f"(SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({wide})) ON COLUMNS(*) INTO NAME \"column\" VALUE value)"
    )


def union_long(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    named = {
        # sources
        "scan_events": sql(
            f"SELECT event_id, event_date, event_name, platform, user_pseudo_id, {N_PARAMS} AS n_params, "
            f"{N_PROPERTIES} AS n_properties, {DIMS} FROM flat"
        ),
        "scan_web": sql("SELECT * FROM web"),
        "scan_new_user": sql("SELECT * FROM nu"),
        "run_sql": sql("SELECT event_name, count(*) AS n, count(DISTINCT user_pseudo_id) AS users FROM flat GROUP BY 1"),
        "reuse_extract": sql(
            union_long(
                "SELECT 'goals' AS report, goal_category AS item, pct FROM counts",
                "SELECT 'sources' AS report, source_category AS item, "
                f"{SOURCE_SHARE} AS pct FROM per_group CROSS JOIN totals",
            ),
            *goal_tables(),
            *source_tables(),
        ),
        # sinks
        "fmt_counts": "SELECT dates, "
        + ", ".join(
            f"format('{{:,}}', {c}) AS {c}"
            for c in ("total_users", "new_users", "returning_users", "fresh_installs", "reinstalls", "users_with_custom_event")
        )
        + f" FROM ({overview()})",
        "fmt_percent": "SELECT dates, format('{:,}', total_users) AS total_users, "
        "format('{:,}', interacted_users) AS interacted_users, "
        + ", ".join(
            f"printf('%.2f%%', {c}) AS {c}" for c in ("bounce_pct", *(f"scrolled_{t}_pct" for t in v.SCROLL_THRESHOLDS))
        )
        + f" FROM ({scroll()})",
        # projections
        "explode_params": sql(PARAMS_UNION),
        "explode_param_max": sql(
            "SELECT event_date, user_pseudo_id, max(previous_first_open_count) AS previous_first_open_count "
            f"FROM flat WHERE {N_PARAMS} > 0 GROUP BY 1, 2"
        ),
        "param_string": sql(
            "SELECT event_id, screen_name, view_id, duration, user_id, goal_selected, sources FROM flat"
        ),
        "param_int": sql("SELECT event_id, percent_scrolled, previous_first_open_count, is_custom_goal FROM flat"),
        "user_prop_string": sql("SELECT event_id, property_user_id AS user_id, age, profession, gender FROM flat"),
        "user_prop_int": sql("SELECT event_id, first_open_time FROM flat"),
        "struct_fields": sql(f"SELECT event_id, {DIMS} FROM flat"),
        "rename_columns": "SELECT dates AS \"Dates\", total_users AS \"Total Users\", interacted_users AS \"Interacted Users\", "
        "bounce_pct AS \"Bounce%\", scrolled_20_pct AS \"≥20%\", scrolled_40_pct AS \"≥40%\", scrolled_60_pct AS \"≥60%\", "
        f"scrolled_80_pct AS \"≥80%\", scrolled_100_pct AS \"100%\" FROM ({scroll()})",
        "order_columns": f"SELECT dates, home_page_view, open_app_appstore, open_app_playstore FROM ({web_events()})",
        "goal_extract": sql("SELECT * FROM goal_rows"),
        # filters
        "filter_platform": sql("SELECT event_id, event_date, event_name FROM android"),
        "filter_event": sql("SELECT event_id, event_date, platform FROM flat WHERE event_name = 'Scroll'"),
        "filter_event_in": sql(
            "SELECT event_id, event_date, event_name FROM flat WHERE event_name IN ('screen_load', 'view_click')"
        ),
        "filter_web_events": sql("SELECT Dates, Event_Name, User_ID FROM web_listed"),
        "filter_screen_in": sql("SELECT * FROM steps"),
        "filter_logged_in": sql(
            union_long(
                "SELECT 'property' AS via, event_id, property_user_id AS user_id FROM flat WHERE property_user_id IS NOT NULL",
                "SELECT 'param' AS via, event_id, user_id FROM flat WHERE user_id IS NOT NULL",
            )
        ),
        "filter_first_day": sql(
            "SELECT event_id, event_date FROM flat WHERE event_date = strftime(epoch_ms(first_open_time), '%Y%m%d')"
        ),
        "filter_explore_actions": sql(
            "SELECT event_date, user_id, actions, count(*) AS n FROM explore_rows GROUP BY 1, 2, 3"
        ),
        "filter_date_range": sql(
            "SELECT event_id, event_date FROM flat WHERE event_date BETWEEN '20240105' AND '20240120'"
        ),
        "filter_date_range_opt": sql(
            union_long(
                "SELECT 'both' AS given, event_id FROM flat WHERE event_date BETWEEN '20240105' AND '20240120'",
                "SELECT 'start' AS given, event_id FROM flat",
            )
        ),
        "filter_dims": sql(
            "SELECT event_id, app_version, country FROM (SELECT event_id, app_version, country FROM flat) "
            "WHERE app_version IN ('1.0.0', '2.0.0') AND country = 'IN'"
        ),
        "filter_dims_unknown": sql(
            "SELECT Dates, User_ID, Device, Country FROM web "
            "WHERE coalesce(Device, 'Unknown') IN ('mobile', 'Unknown') AND coalesce(Country, 'Unknown') IN ('IN', 'US')"
        ),
        "filter_bundle": sql(
            "SELECT * FROM goal_rows WHERE event_date BETWEEN '20240103' AND '20240125' AND os_version = 'Android 11' "
            "AND app_version IN ('1.0.0', '1.1.0') AND country IN ('IN', 'US') AND region IN ('R1', 'R3') "
            "AND city IN ('C0', 'C1', 'C2', 'C3', 'C4') AND gender IN ('male', 'female') "
            "AND age IN ('18-24', '25-34') AND profession = 'student'"
        ),
        "filter_goal_clicks": sql("SELECT event_id, user_id, goal_selected, is_custom_goal FROM clicks", *goal_tables()),
        "filter_mapped_sources": sql(
            "SELECT event_id, user_id, source_category FROM chosen WHERE source_category IS NOT NULL", *source_tables()
        ),
        "empty_report": f"SELECT * FROM ({goals()})",
        # joins
        "join_newuser_events": sql(
            "SELECT * RENAME (label AS descriptive_event), count(*) AS n_rows FROM new_rows GROUP BY ALL"
        ),
        "join_first_seen": sql("SELECT *, count(*) AS n_rows FROM web_typed GROUP BY ALL"),
        "join_scroll": sql("SELECT DISTINCT Dates, User_ID, max_scroll_percent FROM scroll_rows"),
        "join_full_daily": sql("SELECT * FROM pivoted", *explore_tables()),
        "join_left_daily": sql(
            "SELECT pivoted.*, watched.* EXCLUDE (event_date, watchers) FROM pivoted LEFT JOIN watched USING (event_date)",
            *explore_tables(),
        ),
        "daily_total_users": sql("SELECT event_date, count(DISTINCT user_pseudo_id) AS total_users FROM android GROUP BY 1"),
        # aggregations
        "user_day_flags": sql("SELECT * FROM user_flags"),
        "overview_daily": sql(f"SELECT event_date, {OVERVIEW_COUNTS} FROM user_types GROUP BY 1"),
        "pivot_distinct": sql(
            "SELECT event_date, count(DISTINCT user_pseudo_id) AS total_users, "
            + ", ".join(f"{users_with('label = ' + q(label))} AS {snake(label)}" for label in ALL_LABELS)
            + f" FROM {LABELLED_ALL} GROUP BY 1"
        ),
        "pivot_distinct_null": sql(f"SELECT Dates, {web_cells(v.WEB_EVENTS)} FROM web_listed GROUP BY 1"),
        "max_scroll": sql("SELECT * FROM scrolls"),
        "distinct_rows": sql("SELECT * FROM scroll_rows"),
        "interacted_users": sql("SELECT Dates, total_users, interacted_users FROM days", scroll_days()),
        "scroll_thresholds": sql("SELECT * FROM days", scroll_days()),
        "watch_buckets": sql(
            "SELECT event_date, watchers AS total_users, "
            + ", ".join(f"{snake(label)} / watchers * 100 AS {snake(label)}" for label in v.WATCH_LABELS)
            + " FROM watched",
            *explore_tables(),
        ),
        "latest_goal": sql("SELECT * FROM latest", *goal_tables()),
        "goal_counts": sql("SELECT * FROM counts ORDER BY users DESC, goal_category", *goal_tables()),
        "goal_totals": sql(
            "SELECT count(DISTINCT user_id) AS total_users, "
            f"{users_with('goal_selected IS NOT NULL', 'user_id')} AS users_with_goals FROM goal_rows"
        ),
        "source_counts": sql(
            f"SELECT total_logged_in_users, users_who_set_goals, {source_cells('users')} FROM totals", *source_tables()
        ),
        "goals_wide": goals(),
        "sources_wide": sources(),
        "date_bounds": sql("SELECT min(event_date) AS first_day, max(event_date) AS last_day FROM android"),
        "filter_options": options("goal_rows", DIMS.split(", ")),
        "filter_options_known": options(
            "(SELECT coalesce(Device, 'Unknown') AS Device, coalesce(Country, 'none') AS Country, "
            "coalesce(Region, 'NaN') AS Region, City FROM web_listed)",
            ("Device", "Country", "Region", "City"),
            " AND lower({0}) NOT IN ('none', 'unknown', 'nan')",
        ),
        "other_goals": sql("SELECT DISTINCT goal_selected FROM latest WHERE goal_category = 'Others'", *goal_tables()),
        # metrics
        "pct_keep_null": "SELECT dates, reinstalls / nullif(fresh_installs, 0) * 100 AS pct " f"FROM ({overview()})",
        "pct_fill_zero": "SELECT dates, coalesce(reinstalls / nullif(fresh_installs, 0), 0) * 100 AS pct "
        f"FROM ({overview()})",
        "pct_guarded": sql(
            "SELECT event_date, total_users, "
            + ", ".join(f"{snake(label)} / total_users * 100 AS {snake(label)}" for label in v.EXPLORE_LABELS)
            + " FROM pivoted",
            *explore_tables(),
        ),
        "bounce_rate": sql(f"SELECT Dates, {BOUNCE} AS bounce_pct FROM days", scroll_days()),
        "round_half_even": sql("SELECT event_id, round_even((event_id % 800) / 800 * 100, 2) AS pct FROM flat"),
        "missing_zero": sql(
            f"SELECT Dates, {web_cells(v.WEB_EVENTS)}, CAST(0 AS BIGINT) AS never_seen FROM web_listed GROUP BY 1"
        ),
        "missing_omit": sql(
            union_long(
                *(
                    f"SELECT {q(snake(label))} AS name, bool_or(Event_Name = {q(label)}) AS present FROM web_listed"
                    for label in (*v.WEB_EVENTS, "never_seen")
                )
            )
        ),
        "missing_null": sql(
            f"SELECT Dates, {web_cells(v.WEB_EVENTS)}, CAST(NULL AS BIGINT) AS never_seen FROM web_listed GROUP BY 1"
        ),
        "fill_zero_all": sql("SELECT * FROM pivoted", *explore_tables()),
        "fill_zero_one": sql(
            "SELECT DISTINCT Dates, User_ID, coalesce(max_scroll_percent, 0) AS max_scroll_percent FROM scroll_rows"
        ),
        # classification
        "user_type": sql("SELECT event_date, user_pseudo_id, user_type FROM user_types"),
        "install_type": sql("SELECT * FROM installs"),
        "web_user_type": sql("SELECT Dates, User_ID, User_Type, count(*) AS n_rows FROM (SELECT DISTINCT w.Dates, w.User_ID, "
            "n.Dates AS seen, CASE WHEN w.Dates = n.Dates THEN 'New User' ELSE 'Returning User' END AS User_Type "
            "FROM web_listed w LEFT JOIN nu n ON w.User_ID = n.User_ID) GROUP BY 1, 2, 3"),
        "label_onboarding": sql("SELECT event_date, user_pseudo_id, event_name, screen_name, label FROM (SELECT *, "
            f"{ONBOARDING_CASE} AS label FROM steps)"),
        "label_onboarding_all": sql(
            f"SELECT event_date, user_pseudo_id, event_name, screen_name, {DIMS}, label AS app_event FROM total_rows"
        ),
        "label_explore": sql(f"SELECT * EXCLUDE (event_id) FROM explore_rows"),
        "goal_category": sql("SELECT event_id, goal_selected, is_custom_goal, goal_category FROM clicks", *goal_tables()),
        "source_category": sql("SELECT event_id, sources, source_category FROM chosen", *source_tables()),
        # scalar functions
        "coalesce_defaults": sql(
            "SELECT event_id, coalesce(age, 'NA') AS age, coalesce(profession, 'NA') AS profession, "
            "coalesce(gender, 'NA') AS gender FROM flat"
        ),
        "parse_date": sql("SELECT event_id, CAST(strptime(event_date, '%Y%m%d') AS DATE) AS day FROM flat"),
        "format_date": sql(f"SELECT event_id, {ISO} AS day FROM flat"),
        "date_default": sql(
            "SELECT CASE WHEN Device IS NULL THEN DATE '2024-02-01' ELSE Dates END AS Dates, count(*) AS n FROM web GROUP BY 1"
        ),
        "parse_duration": sql(f"SELECT event_id, duration, {DURATION} AS seconds FROM flat"),
        # sort
        "sort_date_desc": sql(f"SELECT {ISO} AS dates, count(*) AS n FROM flat GROUP BY 1 ORDER BY 1 DESC"),
        # reports
        "report_overview": overview(),
        "report_new_user": funnel("new_rows", NEW_LABELS, "TRUE", "NULL"),
        "report_total_user": funnel(LABELLED_ALL, ALL_LABELS, "TRUE", "0"),
        "report_explore": explore(),
        "report_scroll": scroll(),
        "report_web_events": web_events(),
        "report_goals": goals(),
        "report_sources": sources(),
        # reports with filters
        "report_overview_range": overview("event_date BETWEEN '20240110' AND '20240119'"),
        "report_new_user_filtered": funnel(
            "new_rows",
            NEW_LABELS,
            "event_date BETWEEN '20240103' AND '20240128' AND install_type = 'fresh_install' "
            "AND app_version IN ('1.0.0', '2.0.0') AND country IN ('IN', 'US')",
            "NULL",
        ),
        "report_new_user_reinstalls": funnel("new_rows", NEW_LABELS, "install_type = 'reinstall'", "NULL"),
        "report_total_user_filtered": funnel(
            LABELLED_ALL, ALL_LABELS, "event_date >= '20240108' AND region IN ('R1', 'R2') AND os_version = 'Android 12'", "0"
        ),
        "report_explore_filtered": explore("event_date <= '20240125' AND gender = 'NA' AND age IN ('18-24', 'NA')"),
        "report_scroll_new_users": scroll("User_Type = 'New User' AND Dates >= DATE '2024-01-01'"),
        "report_scroll_returning": scroll("User_Type = 'Returning User' AND Dates <= DATE '2024-01-20'"),
        "report_web_filtered": web_events(
            "Device IN ('mobile', 'Unknown') AND Country IN ('IN', 'US') AND User_Type = 'Returning User' "
            "AND Dates BETWEEN DATE '2024-01-02' AND DATE '2024-01-25'"
        ),
        "report_web_new_users": web_events("User_Type = 'New User'"),
        "report_goals_filtered": goals("app_version IN ('1.0.0', '1.1.0') AND event_date <= '20240120'"),
        "report_sources_filtered": sources("gender = 'female' AND event_date >= '20240105'"),
        "report_custom_goals": sql("SELECT DISTINCT goal_selected FROM latest WHERE goal_category = 'Others'", *goal_tables()),
        "report_custom_goals_filtered": sql(
            "SELECT DISTINCT goal_selected FROM latest WHERE goal_category = 'Others'", *goal_tables("city <> 'C1'")
        ),
    }
    named |= {
        # one scan for several reports, and their stored state
        "journey_overview": named["report_overview_range"],
        "journey_new_user": named["report_new_user_filtered"],
        "journey_total_user": named["report_total_user_filtered"],
        "journey_scroll": named["max_scroll"],
        "state_reports": union_long(
            *(
                f"SELECT {q(name)} AS report, dates, name, value FROM (UNPIVOT (SELECT dates, "
                f"CAST(COLUMNS(* EXCLUDE (dates)) AS DOUBLE) FROM ({named[single]})) "
                "ON COLUMNS(* EXCLUDE (dates)) INTO NAME name VALUE value)"
                for name, single in {
                    "overview": "report_overview_range",
                    "new_user_onboarding": "report_new_user_filtered",
                    "total_user_onboarding": "report_total_user_filtered",
                }.items()
            )
        ),
        "state_scroll": named["report_scroll"],
        "reuse_snapshot": named["reuse_extract"],
        # only what is there, and what can be asked for
        "report_explore_present": long_report(
            named["report_explore"],
            [
                "total_users",
                *map(snake, v.EXPLORE_LABELS[:-2]),
                *map(snake, v.WATCH_LABELS),
                *map(snake, v.EXPLORE_LABELS[-2:]),
            ],
            ["total_users", *map(snake, v.WATCH_LABELS)],
        ),
        "report_goals_present": long_row(named["report_goals"], "\"column\" = 'total_users' DESC, value DESC, \"column\""),
        "report_sources_present": long_row(
            named["report_sources_filtered"],
            "list_position(['total_logged_in_users', 'users_who_set_goals', 'group_screen', 'home_screen', "
            "'reward_screen_flow', 'settings_screen'], \"column\")",
        ),
        "checked_goals": sql(
            union_long(
                "SELECT 'extract' AS name, count(*) AS n FROM goal_rows",
                "SELECT 'goals', count(*) FROM goal_rows WHERE app_version IN ('1.0.0', '1.1.0') AND event_date <= '20240120'",
                "SELECT 'goal_clicks', count(*) FROM clicks",
                "SELECT 'sources', 0",
                "SELECT 'known_sources', 0",
                "SELECT 'users', count(*) FROM latest",
                "SELECT 'warnings', 1 + CAST(count(*) = 0 AS BIGINT) FROM clicks",
            ),
            *goal_tables("app_version IN ('1.0.0', '1.1.0') AND event_date <= '20240120'"),
        ),
        "options_overview": page_options("user_types", ISO, {}),
        "options_new_user": page_options(
            "new_rows", ISO, {c: c for c in ("install_type", "os_version", "app_version", "country", "region", "city")}
        ),
        "options_total_user": page_options(
            "android", ISO, {c: c for c in ("os_version", "app_version", "country", "region", "city")}
        ),
        "options_explore": page_options("explore_rows", ISO, {c: c for c in PERSON_AND_PLACE}),
        "options_scroll": page_options("scroll_rows", WEB_ISO, {"user_type": "User_Type"}),
        "options_web": page_options(
            "web_typed",
            WEB_ISO,
            {"device": "Device", "country": "Country", "region": "Region", "city": "City", "user_type": "User_Type"},
            "lower({0}) NOT IN ('none', 'unknown', 'nan')",
        ),
        "options_goals": page_options("goal_rows", ISO, {c: c for c in PERSON_AND_PLACE}),
        "web_rows_by_user": named["join_first_seen"],
        "run_sql_bound": sql(
            "SELECT event_name, count(*) AS n, 'l''été -- \"a\"' AS note FROM flat "
            "WHERE event_date >= '20240105' AND platform IN ('ANDROID', 'IOS') GROUP BY 1"
        ),
    }
    return named
