"""Column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def names(keys: str | Sequence[str]) -> str:
    """Column names for SQL text."""
    return ", ".join(f"`{k}`" for k in listed(keys))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator)


def weight(column: str | None) -> Column:
    """What a record counts: a column's value, or 1."""
    return F.lit(1).cast("bigint") if column is None else F.col(column)


def quoted(name: str) -> Column:
    """A column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(name: str, taken: Sequence[str]) -> str:
    """name, lengthened until none of taken is the same, whatever its case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
