"""Weak supervision: reliabilities of voters, estimated without labels from counted patterns of votes.

A mark is a voter's number times three, plus 0 for a vote against, 1 for an
abstention, 2 for a vote in favour. A pattern is a group, the marks of one item and how
many items have them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per group the log odds of "true" before any vote, and then those of every mark.
Odds = list[list[float]]


def marks(votes: Sequence[Column]) -> Column:
    """The marks of votes of -1, 0 and 1."""
    return F.array(*((3 * i + 1 + vote).cast("int") for i, vote in enumerate(votes)))


def posterior(odds: Odds, group: Column, own_marks: Column) -> Column:
    """P(true | votes) under voters that err independently."""
    table = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in odds))
    logit = F.aggregate(
        own_marks, F.get(F.get(table, group), F.lit(0)), lambda a, m: a + F.get(F.get(table, group), m + 1)
    )
    return 1 / (1 + F.exp(-logit))


def estimated(
    patterns: DataFrame,
    groups: int,
    start: Column,
    rates: Sequence[tuple[Mapping[int, float], Mapping[int, float]]],
    prior: tuple[float, float],
    share: float,
    least: float,
    rounds: int,
    abstentions: bool,
) -> Odds:
    """Expectation-maximisation over ``patterns`` (group, marks, n), from the beliefs ``start``.

    ``rates`` holds for each voter how often it casts -1, 0 and 1 on true and on false
    items; these, and the class sizes ``prior``, count as ``share`` of a group's items, or as
    ``least`` items if that is more, so that "true" keeps its meaning. Where ``abstentions``
    is False they say nothing. Each round is one aggregate; its sums, one row per group and
    mark, come to the driver.
    """
    belief, odds = start, []
    for _ in range(rounds):
        beliefs = patterns.select("group", "n", F.explode("marks").alias("mark"), belief.alias("belief"))
        rows = beliefs.groupBy("group", "mark").agg(
            F.sum(F.col("belief") * F.col("n")).alias("t"), F.sum((1 - F.col("belief")) * F.col("n")).alias("f")
        )
        sums = {(r["group"], r["mark"]): (r["t"], r["f"]) for r in rows.collect()}
        before, odds = odds, []
        for group in range(groups):
            t, f = (sum(sums.get((group, m), (0.0, 0.0))[k] for m in range(3)) for k in (0, 1))
            weight = max(least, share * (t + f))
            own = [math.log((t + weight * prior[0]) / (f + weight * prior[1]))]
            for voter, (true, false) in enumerate(rates):
                for vote in (-1, 0, 1):
                    a, b = sums.get((group, 3 * voter + 1 + vote), (0.0, 0.0))
                    ratio = math.log((a + weight * true[vote]) / (t + weight)) - math.log((b + weight * false[vote]) / (f + weight))
                    own.append(ratio if vote or abstentions else 0.0)
            odds.append(own)
        belief = posterior(odds, F.col("group"), F.col("marks"))
        if before and max(abs(x - y) for a, b in zip(before, odds, strict=True) for x, y in zip(a, b, strict=True)) < 1e-3:
            break
    return odds
