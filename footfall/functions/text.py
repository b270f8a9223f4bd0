"""Lists of fixed values as one expression.

Written as SQL text, a list costs one call into the JVM instead of one or more
per value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Sequence[str | None]) -> Column:
    """An array of strings."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def record_array(fields: Sequence[str], records: Sequence[Sequence[str] | None]) -> Column:
    """An array of structs of strings; a missing record is NULL."""
    empty = f"CAST(NULL AS STRUCT<{', '.join(f'{field}: STRING' for field in fields)}>)"

    def record(values: Sequence[str]) -> str:
        pairs = (f"'{field}', {quoted(value)}" for field, value in zip(fields, values))
        return f"named_struct({', '.join(pairs)})"

    return F.expr(f"array({', '.join(empty if r is None else record(r) for r in records)})")
