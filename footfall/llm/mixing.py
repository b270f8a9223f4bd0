"""Sampling weights that bring a corpus to target shares of source, language and topic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm import work

DIMENSIONS = ("source", "lang", "topic")
#: A target share is the share in the corpus to this power, normalised: below 1 it evens a dimension out.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: The topic of a text is the first of these that it matches.
TOPICS = (
    ("licence", r"(?i)\blicen[cs]ed?\b|all rights reserved"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9] ?\("),
    ("list", r" \| "),
    ("figures", r"[0-9]"),
)
#: The share of all tokens that the query and the pipeline draw.
SHARE = 0.5
TOLERANCE, SWEEPS, MOST_SWEEPS = 1e-6, 4, 60


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    chosen = F.lit("prose")
    for name, pattern in reversed(topics):
        chosen = F.when(text.rlike(pattern), F.lit(name)).otherwise(chosen)
    return chosen


def token_count(text: Column) -> Column:
    """Words of the text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the MD5 of the id, equal in every run; a missing id counts as ''."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def _targets(cells: DataFrame, dimension: str, given: Mapping[str, float] | None) -> DataFrame:
    """(value, goal): target shares of one dimension over the values that have tokens."""
    shares = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    if given is not None:
        pairs = [F.lit(x) for pair in given.items() for x in pair]
        wish = F.coalesce(F.create_map(*pairs)[F.col(dimension)] if pairs else F.lit(None), F.lit(0.0))
    else:
        wish = F.pow(F.col("tokens").cast("double"), F.lit(FLATTEN[dimension]))
    every = Window.partitionBy(F.lit(1))
    return shares.select(dimension, (wish / F.sum(wish).over(every)).alias(f"goal_{dimension}"))


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The cells (source, lang, topic, tokens > 0) with ``weight``, their share after raking.

    Iterative proportional fitting: in turn for each dimension, the cells of a value
    are scaled to its target share, until every share is within ``TOLERANCE``. The
    cells are one row per combination that occurs; each ``SWEEPS`` sweeps are written.
    """
    state = cells
    for dimension in DIMENSIONS:
        state = state.join(_targets(cells, dimension, (targets or {}).get(dimension)), dimension)
    state = work.written(state.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for _ in range(MOST_SWEEPS // SWEEPS):
        for _ in range(SWEEPS):
            for dimension in DIMENSIONS:
                held = F.sum("weight").over(Window.partitionBy(dimension))
                scaled = F.when(held > 0, F.col("weight") * F.col(f"goal_{dimension}") / held).otherwise(0.0)
                state = state.withColumn("weight", scaled)
        state = work.written(state, "raked")
        off = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"goal_{d}")) for d in DIMENSIONS]
        worst = state.select(F.greatest(*off).alias("off")).agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    return state.select(*DIMENSIONS, "tokens", "weight")


def sampling_rates(
    features: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    share: float | None = None,
    once: bool = False,
) -> DataFrame:
    """(source, lang, topic, probability) per cell: how often a document of the cell is drawn on average.

    With ``share`` the draws hold that share of all tokens, however rare a cell is, and a cell
    that is sought more than it has passes 1; with ``once`` it stays at 1, and the others share what it lacks
    in proportion. Without ``share``, the most sought cell is kept whole and none passes 1.
    """
    cells = features.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    wanted = raked(work.written(cells, "cells"), targets).withColumn("rate", F.col("weight") / F.col("tokens"))
    most, total, met = wanted.agg(F.max("rate"), F.sum("tokens"), F.sum("weight")).first()
    scale = share * total / (met or 1.0) if share is not None and total else 1 / (most or 1.0)
    if once and share is not None:
        scale = _capped_scale(wanted, share * (total or 0), scale)
    rate = F.col("rate") * F.lit(scale)
    rate = F.least(rate, F.lit(1.0)) if once else rate
    return work.written(wanted.select(*DIMENSIONS, rate.alias("probability")), "rates")


def _capped_scale(wanted: DataFrame, tokens: float, scale: float) -> float:
    """The scale at which rates, held at 1, draw that many tokens.

    What is drawn is a concave function of the scale, made of straight pieces, so the steps
    rise to the answer and end after as many of them as there are pieces, most often a few.
    """
    while True:
        whole = F.col("rate") * F.lit(scale) >= 1
        held = F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)).alias("held")
        rest = F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0)).alias("rest")
        held, rest = wanted.agg(held, rest).first()
        better = (tokens - held) / rest if rest > 0 else scale
        if better <= scale * (1 + 1e-9):
            return scale
        scale = better


def sampled(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    all_rows: bool = False,
    share: float | None = None,
    once: bool = False,
) -> DataFrame:
    """The documents drawn so that expected tokens meet the target shares; with ``all_rows``, every row with its decision.

    A document comes as often as the whole part of its cell's rate says, and once more if a
    number hashed from its id lies under the rest, so repeated rows share their fate and reruns agree.
    ``share`` is the part of all tokens to draw; with ``once`` no document comes twice, and cells that are
    sought more than they have come whole; without ``share`` the most sought cell is drawn whole and every
    other one in proportion, each document once at most. A missing source or language is the value '',
    one without a target in ``targets`` is not drawn, a text without words has
    probability 1 (it weighs nothing), an empty table stays empty; columns of any name are kept as they are.
    With ``all_rows`` a text is looked at once, and its topic and tokens are stored; else twice, as the drawn rows come whole.
    Tokens are summed per cell before any shuffle, and documents meet their cell in a join by its size: a
    source with a third of all rows is one row of the small side.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), text.alias("text"), *(
        F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in ("source", "lang")
    ))
    rows = own.select("row", "doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), token_count(F.col("text")).alias("tokens"))
    if all_rows:  # nothing of the documents is needed any more, so their topics and tokens are found once
        rows = work.written(rows.drop("row"), "features")
    rates = sampling_rates(rows.select(*DIMENSIONS, "tokens"), targets, share, once)
    joined = rows.join(rates, [*DIMENSIONS], "left")
    chance = F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(0.0)))
    joined = joined.withColumn("probability", chance)
    draws = F.floor("probability") + (uniform(F.col("doc_id")) < F.col("probability") - F.floor("probability")).cast("bigint")
    joined = joined.withColumn("draws", draws)
    if all_rows:
        return joined.select("doc_id", "topic", "tokens", "probability", (F.col("draws") > 0).alias("drawn"), "draws")
    each = F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))).alias("draw")
    return joined.where("draws > 0").select("row", each).select("row.*")
