"""Row counts of a report, known after the run that makes it, and the warnings that follow from them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

NO_ROWS = "no rows are left by the selected filters"
NO_KNOWN_SOURCES = "no row has an entry source of a known group"


class EmptyCheck:
    """Counts rows that meet conditions inside a report's reduction, and hands the totals over when it runs.

    Counts are made by aggregates and observed on the one row above them, not on the rows
    themselves: an observation below a shuffle is lost where adaptive execution finds that
    nothing came through, which is just the case to be told. Rows of a stage that runs again after a
    lost executor count once, since they are part of its result.
    """

    def __init__(self, conditions: Mapping[str, Column]):
        self.conditions = dict(conditions)
        self._observation = Observation(f"rows-{uuid.uuid4().hex}")

    def partial(self) -> dict[str, Column]:
        """Aggregates for the reduction."""
        return {f"rows_{name}": F.count_if(condition) for name, condition in self.conditions.items()}

    def totals(self) -> list[Column]:
        """Aggregates over the reduced rows."""
        return [F.coalesce(F.sum(f"rows_{name}"), F.lit(0).cast("bigint")).alias(f"rows_{name}") for name in self.conditions]

    def observed(self, totals: DataFrame) -> DataFrame:
        return totals.observe(self._observation, *(F.max(f"rows_{name}").alias(name) for name in self.conditions))

    def counts(self) -> dict[str, int]:
        """Rows that met each condition in the first run of the report; waits for it, so run the report first."""
        return self._observation.get

    def warnings(self) -> dict[str, str]:
        """What to tell whoever asked, by report; nothing where there are rows."""
        rows = self.counts()
        found = {}
        if not rows["goal_clicks"]:
            found["goals"] = NO_ROWS
        if not rows["sources"]:
            found["sources"] = NO_ROWS
        elif not rows["known_sources"]:
            found["sources"] = NO_KNOWN_SOURCES
        return found
