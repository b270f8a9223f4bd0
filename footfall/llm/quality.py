"""Quality rules as weak labels: rules vote or abstain, their accuracies are estimated, a posterior decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm import voting, work

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS = 25
#: What the priors are worth, as a share of the documents and in documents at least: "good" keeps its meaning.
PRIOR_SHARE, PRIOR_LEAST = 0.02, 10.0
RULES = ("symbols", "capitals", "shouting", "repeats", "lines", "length", "word_length", "short_words", "letters", "sentences")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``, no NULL) and columns ``STATS`` of each whole text.

    Repeated windows are found by sorting the hashes of a text's windows with their
    places, and only in texts where some hash occurs twice.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))
    window = F.transform(
        F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(0), F.size("hashes") - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.get(F.col("hashes"), i + j) for j in range(WINDOW))),
    )
    rows = rows.withColumn("windows", window)
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed", placed)
    near = lambda i: F.get(F.col("placed"), i)["h"]
    found = F.filter(
        F.transform(
            "placed", lambda p, i: F.when((near(i - 1) == p["h"]) | (near(i + 1) == p["h"]), p["i"])
        ),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("found", F.sort_array(found))
    span = F.aggregate(
        "found",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
    )["n"]
    lines = F.filter(F.split("text", "\n"), lambda x: _without(x, SPACES) > 0)
    rows = rows.withColumn("lines", lines)
    return rows.select(
        *docs.columns,
        _size(F.col("hashes")).alias("n_words"),
        _without(F.col("text"), SPACES).cast("bigint").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        (_size(F.col("lines")) - _size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _size(F.col("lines")).alias("n_lines"),
        F.coalesce(span, F.lit(0).cast("bigint")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> list[Column]:
    """One vote of each rule: 1 good, -1 bad, 0 where it abstains."""
    n = F.col("n_words")
    text = F.col("text")
    share = lambda x: F.try_divide(x, n)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    capitals = F.try_divide(F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", "")), F.col("word_chars"))
    letters = F.try_divide(F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", "")), F.col("word_chars"))

    def vote(bad: Column, good: Column | None = None) -> Column:
        chosen = F.when(bad, -1)
        return (chosen.when(good, 1) if good is not None else chosen).otherwise(0)

    symbols = share(F.col("n_symbols"))
    long = F.try_divide(F.col("word_chars"), n)
    repeats = share(F.col("n_repeat_words"))
    few = count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])")
    given = {
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "capitals": vote(capitals > 0.3, capitals < 0.12),
        "shouting": vote(share(count(r"!!")) > 0.05),
        "repeats": vote(repeats > 0.2, repeats < 0.01),
        "lines": vote(F.try_divide(F.col("n_dup_lines"), F.col("n_lines")) > 0.3),
        "length": vote(n < 20, n >= 50),
        "word_length": vote((long < 2.5) | (long > 12), (long > 3.5) & (long < 9)),
        "short_words": vote((n >= 20) & (share(few) < 0.02), share(few) > 0.08),
        "letters": vote(letters < 0.75, letters > 0.9),
        "sentences": vote(F.lit(False), share(count(r"[.!?](?![^\x20\x09-\x0D])")) > 0.02),
    }
    return [F.coalesce(given[name], F.lit(0)) for name in RULES]


def posterior(odds: voting.Odds) -> Column:
    return voting.posterior(odds, F.lit(0), F.col("marks"))


def estimated(patterns: DataFrame) -> voting.Odds:
    """Accuracies of the rules from the counted patterns of votes, at most 3 to the number of rules."""
    bad = F.exists("marks", lambda m: m % 3 == 0)
    return voting.estimated(
        patterns.select(F.lit(0).alias("group"), "marks", "n"),
        groups=1,
        start=F.when(bad, 0.1).otherwise(0.95),
        rates=[({-1: 0.01, 0: 0.29, 1: 0.7}, {-1: 0.2, 0: 0.5, 1: 0.3})] * len(RULES),
        prior=(0.9, 0.1),
        share=PRIOR_SHARE,
        least=PRIOR_LEAST,
        rounds=ROUNDS,
        abstentions=True,
    )


def _patterns(seen: DataFrame) -> DataFrame:
    return work.written(seen.groupBy("marks").agg(F.count("*").alias("n")), "patterns")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS, base_failed, posterior, kept), one row per row of ``docs``.

    A text of fewer than 20 words, or with over 30 % of them in repeated windows, fails;
    the others are kept if the posterior probability of "good" is one half or more. The
    texts are read once: votes and counts are written, patterns of votes are counted
    before the shuffle. NULL is an empty text, which fails; a missing id is kept as it
    is; repeated rows are judged alike, and an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = statistics(texts).select("doc_id", *STATS, voting.marks(votes()).alias("marks"))
    seen = work.written(seen, "votes")
    odds = estimated(_patterns(seen))
    rows = seen.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(odds))
    kept = ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    return rows.select("doc_id", *STATS, "base_failed", "posterior", kept.alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, whatever their columns.

    Rows are written once with what was found in them, so no text is judged twice; none is shuffled.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    texts = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = statistics(texts).withColumn("marks", voting.marks(votes()))
    seen = work.written(seen.select("__row", *STATS, "marks"), "marked")
    odds = estimated(_patterns(seen))
    return seen.where(~base_failed() & (posterior(odds) >= 0.5)).select("__row.*")
