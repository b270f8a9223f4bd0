"""Rule lists as column expressions.

A row's (event, screen, view) is looked up among the rules as one value. The
expression mentions each input once or twice, however many rules there are, so
it stays small when the optimizer moves it into a filter. It needs no join and
runs inside the scan's generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.text import record_array, text_array
from footfall.vocabulary import Rule


FIELDS = ("event", "screen", "view")


def _number(patterns: Sequence[tuple[str, ...] | None], values: Sequence[Column]) -> Column:
    """One-based place of the row's values among the patterns; None is never met."""
    fields = FIELDS[: len(values)]
    row = F.struct(*(value.alias(field) for field, value in zip(fields, values)))
    return F.array_position(record_array(fields, patterns), row)


def rule_number(rules: Sequence[Rule], event: Column, screen: Column, view: Column | None = None) -> Column:
    """One-based number of the rule a row meets, 0 when it meets none."""
    anywhere = {(r.event, r.screen) for r in rules if r.view is None}
    in_view = {(r.event, r.screen) for r in rules if r.view is not None}
    if anywhere & in_view:
        raise ValueError("a screen event may be labelled by view or regardless of it, not both")
    if in_view and view is None:
        raise ValueError("these rules test the view, so a view column is needed")
    number = _number([(r.event, r.screen) if r.view is None else None for r in rules], [event, screen])
    if not in_view:
        return number
    return number + _number(
        [(r.event, r.screen, r.view) if r.view is not None else None for r in rules], [event, screen, view]
    )


def rule_label(rules: Sequence[Rule], event: Column, screen: Column, view: Column | None = None) -> Column:
    """Label of the rule a row meets, else NULL."""
    labels = text_array([rule.label for rule in rules])
    return F.get(labels, (rule_number(rules, event, screen, view) - 1).cast("int"))
