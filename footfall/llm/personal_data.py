"""Spans of personal data: labelers vote on candidates, their reliabilities are estimated, a span classifier decides."""

from __future__ import annotations

import math
from collections.abc import Callable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm import voting, work

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Runs that cannot be given back are possessive and start where a run starts, so a long run is
#: read once; what is matched is what the plain patterns match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates, which only the classifier can turn into spans.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}+)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
# --- fixed values: gazetteers and cues ----------------------------------------
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "in", "ch", "at", "nl")
CALLING = r"^\+?\(?(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|server|host|address|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
}
COUNTER_CUES = r"(?i)\b(?:version|isbn|order|invoice|section|chapter|figure|article|serial|no)\b"
# ------------------------------------------------------------------------------
LABELERS = ("pattern", "gazetteer", "context", "border", "shape")
FEATURES = ("before", "after", "length", "digits", "context", "gazetteer")
VALUES = 24  # values that a feature can take, at most
CONTEXT = 40
BLOCK = 256  # items that a list grows by at a time
ROUNDS = 15
#: What a prior vote weighs, in spans of each kind; its shape says that labelers are right more often than not.
PRIOR = 20.0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of the value pass Luhn's test."""
    digits = F.reverse(F.split(_digits(value), ""))
    at = F.sequence(F.lit(0), F.length(_digits(value)) - 1)
    kept = F.filter(digits, lambda d: d != "")
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    total = F.aggregate(
        F.zip_with(kept, at, lambda d, i: doubled(d.cast("int"), i)), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def _small_parts(value: Column) -> Column:
    """Whether each of the dotted numbers is at most 255, whatever zeros lead it."""
    return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return _small_parts(value)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(value)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, kind: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each item the state before it: ``start`` for the first, then ``step(state, item)`` of the one before.

    Lists grow by ``BLOCK`` items at a time, so the work does not grow with the square of the items.
    """
    none = F.array().cast(f"array<{kind}>")
    first = F.struct(start.cast(kind).alias("state"), none.alias("states"))
    more = lambda a, x: F.struct(
        step(a["state"], x).cast(kind).alias("state"), F.concat(a["states"], F.array(a["state"])).alias("states")
    )

    def block(a: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(a["state"].alias("state"), none.alias("states")), more)
        return _bound(own, lambda o: F.struct(o["state"].alias("state"), F.concat(a["blocks"], F.array(o["states"])).alias("blocks")))

    def over(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int"))
        begin = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))
        blocks = F.aggregate(numbers, begin, lambda a, k: block(a, F.slice(all_items, k * BLOCK + 1, BLOCK)))
        return F.flatten(blocks["blocks"])

    short = lambda i: F.aggregate(i, first, more)["states"]
    return _bound(items, lambda i: F.when(F.size(i) <= BLOCK, short(i)).otherwise(over(i)))


def _with_matches(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """A column of (start, value, left, after) of the leftmost matches that do not overlap; starts count code points.

    A match starts after the texts between the matches and the matches before it.
    ``left`` is the ``CONTEXT`` code points before it, ``after`` the one behind it; both come from the texts
    between the matches and the neighbouring matches, so the whole text is never walked for a match.
    """
    hit = F.col("text").rlike(pattern)
    rows = rows.withColumns(
        {
            f"{name}_gaps": F.when(hit, F.split("text", pattern, -1)),
            f"{name}_values": F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))),
        }
    )
    gaps, values = F.col(f"{name}_gaps"), F.col(f"{name}_values")
    n = F.size(values)
    last = lambda text: F.right(text, F.lit(CONTEXT))
    pieces = F.zip_with(
        F.slice(gaps, 1, n),
        values,
        lambda gap, value: F.struct(
            (F.length(gap) + F.length(value)).alias("size"), last(gap).alias("gap"), last(F.concat(last(gap), value)).alias("tail"), F.length(gap).alias("gap_size")
        ),
    )
    places = F.zip_with(
        _running(F.transform(pieces, lambda p: p["size"]), "int", F.lit(0), lambda a, x: a + x),
        _running(F.transform(pieces, lambda p: p["tail"]), "string", F.lit(""), lambda a, x: last(F.concat(a, x))),
        lambda at, left: F.struct(at.alias("at"), left.alias("left")),
    )
    behind = F.zip_with(
        F.slice(gaps, 2, n),
        F.concat(F.slice(values, 2, n), F.array(F.lit(""))),
        lambda gap, value: F.substring(F.when(gap == "", value).otherwise(gap), 1, 1),
    )
    matches = F.zip_with(
        F.zip_with(places, pieces, lambda a, p: F.struct((a["at"] + p["gap_size"]).alias("start"), last(F.concat(a["left"], p["gap"])).alias("left"))),
        F.zip_with(values, behind, lambda value, after: F.struct(value.alias("value"), after.alias("after"))),
        lambda a, v: F.struct(a["start"].alias("start"), v["value"].alias("value"), a["left"].alias("left"), v["after"].alias("after")),
    )
    return rows.withColumn(name, F.when(n > 0, matches)).drop(f"{name}_gaps", f"{name}_values")


def _character(place: Column) -> Column:
    """0 for none or white space, 1 for a letter, digit or underscore, 2 for others."""
    return F.when((place == "") | place.rlike(r"^\s"), 0).when(place.rlike(r"^[\p{L}\p{N}_]"), 1).otherwise(2)


def _span(kind: str, match: Column, base: bool) -> Column:
    start, value, left, after = (match[c] for c in ("start", "value", "left", "after"))
    length, n = F.length(value), F.length(_digits(value))
    before = F.right(left, F.lit(1))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    known = {
        "email": F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*DOMAINS),
        "ip": ~value.rlike(RESERVED),
        "card": _digits(value).rlike(ISSUERS),
        "phone": value.rlike(CALLING),
    }[kind]
    typical = {"email": length.between(6, 64), "ip": length.between(7, 15), "card": n.between(13, 16), "phone": n.between(10, 13)}[kind]
    edge = (_character(before) == 1) | (_character(after) == 1)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        start.alias("start"),
        (start + length).alias("end"),
        (_passes(kind, value) if base else F.lit(False)).alias("base"),
        (vote(_passes(kind, value), F.lit(kind == "card")) if base else F.lit(0)).alias("pattern"),
        vote(known, ~known).alias("gazetteer"),
        vote(left.rlike(CUES[kind]), left.rlike(COUNTER_CUES)).alias("context"),
        vote(~edge, edge).alias("border"),
        vote(typical, ~typical).alias("shape"),
        _character(before).alias("before"),
        _character(after).alias("after"),
        F.least(F.floor(length / 4), F.lit(16)).cast("int").alias("length"),
        F.least(n, F.lit(20)).alias("digits"),
    )


def _spans_of(kind: str, base: bool) -> Callable[[Column], Column]:
    return lambda match: _span(kind, match, base)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the candidate spans of each whole text with votes and features; one row per row of ``docs``.

    A base match that fails its test stays a candidate, a number only if it has a
    card's length; a loose candidate that overlaps a base span is dropped. The work grows
    with the length of a text, however many matches it holds.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = []
    for name, patterns in (("base", BASE), ("loose", LOOSE)):
        for kind, pattern in patterns.items():
            column = f"{name}_{kind}"
            rows = _with_matches(rows, column, pattern)
            found.append(F.coalesce(F.transform(column, _spans_of(kind, name == "base")), F.array().cast(SPANS)))
    rows = rows.select("doc_id", F.array_sort(F.transform(F.concat(*found), _by_place)).alias("spans"))
    ends = _running(F.col("spans"), "int", F.lit(0), lambda a, s: F.when(s["base"], F.greatest(a, s["end"])).otherwise(a))
    starts = _running(F.reverse("spans"), "int", F.lit(2**31 - 1), lambda a, s: F.when(s["base"], s["start"]).otherwise(a))
    around = F.zip_with(ends, F.reverse(starts), lambda e, s: F.struct(e.alias("end"), s.alias("start")))
    placed = F.zip_with("spans", around, lambda s, a: F.struct(s.alias("span"), a.alias("sure")))
    number = lambda s: (s["kind"] == KINDS.index("card")) & s["digits"].between(12, 19)
    loose = lambda s: s["pattern"] == 0
    free = lambda p: (p["sure"]["end"] <= p["span"]["start"]) & (p["sure"]["start"] >= p["span"]["end"])
    kept = F.filter(placed, lambda p: p["span"]["base"] | ((loose(p["span"]) | number(p["span"])) & free(p)))
    spans = F.transform(kept, lambda p: F.struct(*(p["span"][c].alias(c) for c in FIELDS)))
    return rows.select("doc_id", F.when(F.size("spans") > 0, spans).otherwise(F.array().cast(SPANS)).alias("spans"))


FIELDS = ("kind", "start", "end", "base", *LABELERS, *(f for f in FEATURES if f not in LABELERS))


def _by_place(span: Column) -> Column:
    """The span with its place first, so that spans sort by it."""
    return F.struct(*(span[c].alias(c) for c in sorted(FIELDS, key=lambda c: c not in ("start", "end"))))


SPANS = (
    "array<struct<kind:int,start:int,end:int,base:boolean,pattern:int,gazetteer:int,context:int,border:int,shape:int,"
    "before:int,after:int,length:int,digits:int>>"
)


def reliabilities(patterns: DataFrame) -> voting.Odds:
    """How far a vote of each labeler speaks for a span, per kind; abstentions say nothing."""
    start = F.when(F.get("marks", F.lit(0)) == 2, 0.95).when(F.aggregate("marks", F.lit(0), lambda a, m: a + m % 3 - 1) > 1, 0.6)
    return voting.estimated(
        patterns,
        groups=len(KINDS),
        start=start.otherwise(0.1),
        rates=[({-1: 0.05, 0: 0.55, 1: 0.4}, {-1: 0.4, 0: 0.55, 1: 0.05})] * len(LABELERS),
        prior=(0.5, 0.5),
        share=0.0,
        least=PRIOR,
        rounds=ROUNDS,
        abstentions=False,
    )


def trained(spans: DataFrame) -> voting.Odds:
    """The span classifier: Bayes' rule over single features, from counts weighed by the estimated posterior.

    Per kind the log odds of a span, and then of each value of each feature; values lie
    below ``VALUES``. Only counts per kind, feature and value come to the driver.
    """
    votes = voting.marks([F.col(c) for c in LABELERS])
    values = F.array(*((VALUES * i + F.col(f) + F.lit(1 if f in LABELERS else 0)).cast("int") for i, f in enumerate(FEATURES)))
    patterns = spans.groupBy(F.col("kind").alias("group"), votes.alias("marks"), values.alias("values")).agg(F.count("*").alias("n"))
    patterns = work.written(patterns, "span-patterns")
    odds = reliabilities(patterns.groupBy("group", "marks").agg(F.sum("n").alias("n")))
    belief = voting.posterior(odds, F.col("group"), F.col("marks"))
    weighed = patterns.select("group", "n", belief.alias("belief"), F.explode("values").alias("value"))
    true, false = F.sum(F.col("belief") * F.col("n")), F.sum((1 - F.col("belief")) * F.col("n"))
    sums = {(r["group"], r["value"]): (r["t"], r["f"]) for r in weighed.groupBy("group", "value").agg(true.alias("t"), false.alias("f")).collect()}
    classifier = []
    for group in range(len(KINDS)):
        t, f = (PRIOR / 2 + sum(sums.get((group, v), (0.0, 0.0))[k] for v in range(VALUES)) for k in (0, 1))
        own = [math.log(t / f)]
        for value in range(VALUES * len(FEATURES)):
            a, b = sums.get((group, value), (0.0, 0.0))
            own.append(math.log((a + 1) / (t + VALUES)) - math.log((b + 1) / (f + VALUES)) if a + b else 0.0)
        classifier.append(own)
    return classifier


def _probability(classifier: voting.Odds, span: Column) -> Column:
    values = F.array(*((VALUES * i + span[f] + F.lit(1 if f in LABELERS else 0)).cast("int") for i, f in enumerate(FEATURES)))
    return voting.posterior(classifier, span["kind"], values)


def _listed(spans: Column) -> Column:
    """kind:start:end of the spans by start and then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per row of ``docs``.

    The counts and the digest are of the base spans; ``spans`` lists those that the
    classifier adds as well. Texts are read once and never shuffled: the candidates of
    each row are written, and only counts of vote patterns are. NULL is an empty text,
    without spans; ids and repeated rows stay as they are; an empty table gives none. A very
    long text is one row of one task; its matches are found and judged in time that grows with its length.
    """
    rows = work.written(candidates(docs), "spans")
    classifier = trained(rows.select(F.inline("spans")))
    chosen = F.filter("spans", lambda s: s["base"] | (_probability(classifier, s) >= 0.5))
    rows = rows.withColumn("chosen", chosen).withColumn("sure", F.filter("spans", lambda s: s["base"]))
    count = lambda kind: F.size(F.filter("sure", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    return rows.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_listed(F.col("sure")), 256).alias("base_sha256"),
        _listed(F.col("chosen")).alias("spans"),
        (F.size("chosen") - F.size("sure")).cast("bigint").alias("n_added"),
    )
