"""Activity matched with the days its user was first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import vocabulary as v

MISSING_USER_SPREAD = 64


def _user_key(user: Column) -> Column:
    return F.concat(F.lit("u"), user).alias("match_key")


def first_days(new_user: DataFrame) -> DataFrame:
    """One row per user, as ``match_key``: ``first_days`` (day, rows on it) and ``first_rows`` in all.

    Rows are counted per (user, day) first, so a user's array has at most one
    short element per calendar day, whatever the number of copies. They are
    grouped on the key they are joined on, so the join shuffles them no more.
    """
    keyed = new_user.where(F.col("User_ID").isNotNull()).select(_user_key(F.col("User_ID")), "Dates")
    per_day = keyed.groupBy("match_key", "Dates").agg(F.count("*").alias("n"))
    return per_day.groupBy("match_key").agg(
        F.collect_list(F.when(F.col("Dates").isNotNull(), F.struct("Dates", "n"))).alias("first_days"),
        F.sum("n").alias("first_rows"),
    )


def with_first_seen(rows: DataFrame, new_user: DataFrame, user: str = "User_ID", day: str = "Dates") -> DataFrame:
    """Adds how often a left join by user alone would meet each row.

    ``new_rows`` counts first-seen rows of the user on the row's own day,
    ``returning_rows`` all others, or 1 for a user never seen. Joining counts
    keeps the result linear where copies of a user on both sides would
    otherwise multiply. Rows without a user match nothing, so they are spread
    over many keys instead of meeting in one task.
    """
    joined = with_match_key(rows, user).join(first_days(new_user), "match_key", "left").drop("match_key")
    return counted_matches(joined, day)


def with_match_key(rows: DataFrame, user: str) -> DataFrame:
    """Adds the key that rows are matched on: of the user, or one of many that match nobody."""
    others = [c for c in rows.columns if c != user]
    spread = F.pmod(F.xxhash64(*others), F.lit(MISSING_USER_SPREAD)).cast("string")
    return rows.withColumn("match_key", F.coalesce(_user_key(F.col(user)), F.concat(F.lit("n"), spread)))


def counted_matches(joined: DataFrame, day: str) -> DataFrame:
    """Rows with the days of :func:`first_days` beside them, as the two counts of :func:`with_first_seen`."""
    same_day = F.get(F.col("first_days.n"), (F.array_position("first_days.Dates", F.col(day)) - 1).cast("int"))
    return (
        joined.withColumn("new_rows", F.coalesce(same_day, F.lit(0).cast("bigint")))
        .withColumn("returning_rows", F.coalesce(F.col("first_rows") - F.col("new_rows"), F.lit(1).cast("bigint")))
        .drop("first_days", "first_rows")
    )


def as_user_types(matched: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per user type met, as ``User_Type`` and the number of rows ``n_rows``."""
    copies = F.lit(1).cast("bigint") if copies is None else copies
    kinds = F.array(
        F.struct(F.lit(v.WEB_NEW_USER).alias("User_Type"), F.col("new_rows").alias("met")),
        F.struct(F.lit(v.WEB_RETURNING_USER).alias("User_Type"), F.col("returning_rows").alias("met")),
    )
    kept = [c for c in matched.columns if c not in ("new_rows", "returning_rows", "n_rows")]
    return (
        matched.withColumn("copies", copies)
        .withColumn("kind", F.explode(kinds))
        .where("kind.met > 0")
        .select(*kept, "kind.User_Type", (F.col("kind.met") * F.col("copies")).alias("n_rows"))
    )


def of_user_types(matched: DataFrame, user_types: list[str]) -> DataFrame:
    """Rows met as at least one of the user types; no types means no filter."""
    if not user_types:
        return matched
    met = F.lit(False)
    if v.WEB_NEW_USER in user_types:
        met = met | (F.col("new_rows") > 0)
    if v.WEB_RETURNING_USER in user_types:
        met = met | (F.col("returning_rows") > 0)
    return matched.where(met)


def only_new(user_types: list[str]) -> bool:
    """Whether new users are asked for and returning ones are not."""
    return v.WEB_NEW_USER in user_types and v.WEB_RETURNING_USER not in user_types


def first_seen_that_day(user_days: DataFrame, new_user: DataFrame) -> DataFrame:
    """The rows of (``Dates``, ``User_ID``), one each, whose user was first seen on that very day.

    Rows reduced to one per day and user keep their layout: only the first-seen
    table is shuffled, once. Without a day or a user a row is never new.
    """
    return user_days.join(new_user.select("Dates", "User_ID").distinct(), ["Dates", "User_ID"], "left_semi")
