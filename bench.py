"""Times the eight reports and prints one JSON line.

The input tables are derived from ``$BENCH_SF_DIR`` and written once as
Parquet (``prepare``, not part of the value); every report then reads them
through the scans, warm, and its median of three runs counts.

``python bench.py --forms`` times plainer forms of some reports beside ours.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import footfall as ff
from catalog import adapter
from footfall import vocabulary as v
from footfall.operators.filters import on_android
from footfall.plans import extracts as x

RUNS = 3


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("footfall-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepared(spark: SparkSession, sf_dir: str) -> ff.Tables:
    """The tables, written once in the shared folder of the session, if it names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = tempfile.mkdtemp(prefix="run-", dir=shared or tempfile.gettempdir())
    adapter.write_tables(adapter.tables(spark, sf_dir), f"{path}/tables")
    return ff.Tables(
        ff.scan_events(spark, f"{path}/tables/events"),
        ff.scan_web(spark, f"{path}/tables/web_user_data"),
        ff.scan_new_user(spark, f"{path}/tables/new_user"),
    )


def reports(t: ff.Tables) -> dict[str, Callable[[], DataFrame]]:
    return {
        "overview": lambda: ff.overview(t.events),
        "new_user_onboarding": lambda: ff.new_user_onboarding(t.events),
        "total_user_onboarding": lambda: ff.total_user_onboarding(t.events),
        "explore_journey": lambda: ff.explore_journey(t.events, missing="zero"),
        "scroll_depth": lambda: ff.scroll_depth(t.events, t.web_user_data, t.new_user),
        "web_events": lambda: ff.web_events(t.web_user_data, t.new_user),
        "goal_categories": lambda: ff.goal_categories(ff.goal_rows(t.events)),
        "goal_sources": lambda: ff.goal_sources(ff.goal_rows(t.events)),
    }


def forms(t: ff.Tables) -> dict[str, Callable[[], DataFrame]]:
    """Plainer forms of the same results, for comparison."""

    def six_distinct_counts() -> DataFrame:
        kind, user = F.col("user_type"), F.col("user_pseudo_id")
        tests = [kind != v.RETURNING_USER, kind == v.RETURNING_USER, kind == v.FRESH_INSTALL, kind == v.REINSTALL]
        tests.append(F.col("custom_event") == 1)
        counts = (F.count_distinct(F.when(test, user)).alias(f"c{i}") for i, test in enumerate(tests))
        days = x.classified_user_days(t.events).groupBy("event_date")
        return days.agg(F.count_distinct(user).alias("total"), *counts).orderBy(F.desc("event_date"))

    def exploded_params() -> DataFrame:
        wanted = F.col("param.key") == v.PREVIOUS_FIRST_OPEN_COUNT
        rows = on_android(t.events).withColumn("param", F.explode("event_params"))
        flags = rows.groupBy("event_date", "user_pseudo_id").agg(
            F.max(F.col("event_name") == v.FIRST_OPEN).alias("opened"),
            F.max(F.when(wanted, F.col("param.value.int_value"))).alias("earlier"),
        )
        return flags.groupBy("event_date").agg(F.count("*"), F.count_if("opened"), F.max("earlier"))

    def pivot_and_join() -> DataFrame:
        rows = x.total_user_rows(t.events).withColumn("app_event", F.coalesce("app_event", F.lit(v.NO_EVENT)))
        labels = [*v.ONBOARDING_LABELS, v.NO_EVENT, v.NO_CUSTOM_EVENT]
        counts = rows.groupBy("event_date").pivot("app_event", labels).agg(F.count_distinct("user_pseudo_id"))
        total = rows.groupBy("event_date").agg(F.count_distinct("user_pseudo_id").alias("total"))
        return counts.na.fill(0).join(total, "event_date", "left").orderBy(F.desc("event_date"))

    def lambda_lookups() -> DataFrame:
        screen = F.get(F.filter("event_params", lambda p: p.key == v.SCREEN_NAME), F.lit(0)).value.string_value
        label = F.lit(None)
        for rule in reversed(v.ONBOARDING_RULES):
            label = F.when((F.col("event_name") == rule.event) & (screen == rule.screen), rule.label).otherwise(label)
        rows = on_android(t.events).withColumn("label", label)
        return rows.groupBy("event_date", "label").agg(F.count_distinct("user_pseudo_id"))

    def rows_joined() -> DataFrame:
        rows = x.new_installs(t.events).join(x.onboarding_events(t.events), ["event_date", "user_pseudo_id"], "left")
        key = F.concat_ws("|", "event_name", "screen_name")
        return rows.groupBy("event_date", key).agg(F.count_distinct("user_pseudo_id"))

    def six_joins() -> DataFrame:
        rows = x.scroll_rows(t.events, t.web_user_data, t.new_user)
        daily = rows.groupBy("Dates").agg(F.count_distinct("User_ID").alias("total"))
        for low in (1, *v.SCROLL_THRESHOLDS):
            reached = rows.where(F.col("max_scroll_percent") >= low)
            daily = daily.join(reached.groupBy("Dates").agg(F.count_distinct("User_ID").alias(f"n{low}")), "Dates", "left")
        return daily.orderBy(F.desc("Dates"))

    return {
        "overview: six distinct counts": six_distinct_counts,
        "overview: all parameters exploded": exploded_params,
        "total_user_onboarding: pivot and join": pivot_and_join,
        "total_user_onboarding: CASE over lambda lookups": lambda_lookups,
        "new_user_onboarding: rows joined": rows_joined,
        "scroll_depth: six joins": six_joins,
    }


def timed(build: Callable[[], DataFrame]) -> float:
    def once() -> float:
        started = time.perf_counter()
        build().collect()
        return time.perf_counter() - started

    once()
    return round(statistics.median(once() for _ in range(RUNS)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    started = time.perf_counter()
    tables = prepared(spark, sf_dir)
    prepare = round(time.perf_counter() - started, 3)
    times = {name: timed(build) for name, build in reports(tables).items()}
    line = {
        "metric": "warm median seconds, eight reports",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "prepare": prepare,
    }
    if "--forms" in sys.argv:
        line["forms"] = {name: timed(build) for name, build in forms(tables).items()}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
