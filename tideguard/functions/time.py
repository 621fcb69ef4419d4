"""Time expressions. Batch tables keep timestamp_ntz, on which windows and ranges do not depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_MICROS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000,
}


def micros(span: str) -> int:
    """'6 hours' -> 21600000000. Units from microsecond to week, singular or plural; several may be joined ('1 hour 30 minutes')."""
    parts = span.lower().removeprefix("interval ").split()
    if not parts or len(parts) % 2:
        raise ValueError(f"not a span: {span!r}")
    total = 0
    for n, unit in zip(parts[::2], parts[1::2], strict=True):
        if unit.rstrip("s") not in UNIT_MICROS:
            raise ValueError(f"not a unit: {unit!r}")
        total += int(n) * UNIT_MICROS[unit.rstrip("s")]
    if total < 0:
        raise ValueError(f"a negative span: {span!r}")
    return total


def seconds(span: str) -> int | float:
    """A span's seconds, a whole number where they are one."""
    whole, rest = divmod(micros(span), 1_000_000)
    return whole if not rest else micros(span) / 1e6


def interval(span: str) -> str:
    """A span as SQL text."""
    whole, rest = divmod(micros(span), 1_000_000)
    return f"interval '{whole}.{rest:06}' second"


def window_start(time_col: str, size: str, slide: str | None = None) -> Column:
    return F.window(F.col(time_col), size, slide).getField("start")


def elapsed(earlier: str, later: str) -> Column:
    """Seconds between two time columns, exact to the microsecond."""
    return F.expr(f"timestampdiff(MICROSECOND, {earlier}, {later})") / F.lit(1e6)
