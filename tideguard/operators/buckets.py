"""Sums over moving intervals of a key's events, dealt by time buckets so that a hot key is many tasks' work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.functions.columns import listed, quoted, spare
from tideguard.functions.columns import names as sql_names
from tideguard.functions.time import interval, micros

#: A span is cut into at most so many buckets.
PARTS = 24


def bucket_at(df: DataFrame, time: str, length: int) -> Column:
    """The number of a time's bucket of length microseconds; null for a null time. Exact before 1970 too."""
    zoned = dict(df.dtypes)[time] == "timestamp"
    at = F.unix_micros(F.col(time)) if zoned else F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(`{time}` as timestamp_ntz))")
    step = F.lit(length).cast("bigint")
    return ((at - F.pmod(at, step)) / step).cast("bigint")


def sums_within(
    probes: DataFrame, events: DataFrame, keys: str | Sequence[str], span: str, values: Mapping[str, Column], ahead: bool, time_col: str = "ts", bucket: str | None = None
) -> DataFrame:
    """probes with, for each name in values, the sum over events of the same key in [time - span, time] or, with ahead,
    (time, time + span]; 0 where there are none. A sum has the type that Spark's sum of the value has, whatever the span.

    A bucket is a divisor of the span, at most that given. An interval is the buckets wholly inside it, whose totals are summed
    before they move, and a part of the first and of the last. So an event is copied twice, whatever the span, and a
    window partition holds one key's rows of two buckets. Null keys are one key; a null time meets null times only. A span
    of 0 counts equal times, and nothing with ahead. Columns of probes may have any name; one named as a value is replaced.
    """
    keys, names, size = listed(keys), list(values), micros(span)
    width = 1_000_000 if not size else gcd(size, micros(bucket)) if bucket else next(size // n for n in range(PARTS, 0, -1) if size % n == 0)
    steps = size // width
    kept = [c for c in probes.columns if c not in names]
    t, bucket_, probe = (spare(x, keys) for x in ("__t", "__bucket", "__probe"))
    sums = [spare(f"__near{i}", keys) for i in range(len(names))]
    fars = [spare(f"__far{i}", keys) for i in range(len(names))]
    held = [spare(f"__c{i}", keys) for i in range(len(kept))]
    by = [quoted(k) for k in keys]
    same = probes is events and not ahead
    kind = dict(probes.dtypes)[time_col]

    def keyed(df: DataFrame, *more: Column) -> DataFrame:
        at = df.select(*by, quoted(time_col).cast(kind).alias(t), *more)
        return at.withColumn(bucket_, bucket_at(at, t, width))

    weighed = [F.coalesce(v, F.lit(0).cast(events.select(v).schema[0].dataType)).alias(s) for v, s in zip(values.values(), sums)]
    asked = keyed(probes, *[quoted(c).alias(h) for c, h in zip(kept, held)], F.lit(True).alias(probe), *(weighed if same else []))
    near = asked.select(*by, t, bucket_, *sums) if same else keyed(events, *weighed)
    rows = asked if same else asked.unionByName(near, allowMissingColumns=True)
    part = f"partition by {sql_names([*keys, bucket_])} order by {t}"
    upto, since = "range between unbounded preceding and current row", "range between current row and unbounded following"
    if steps:
        whole = whole_buckets(None if same else asked, near, keys, sums, fars, steps, ahead, t, bucket_)
        shift = f"{'-' if ahead else '+'} {interval(span)}"
        moved = near.where(F.col(bucket_).isNotNull()).select(
            *by, F.expr(f"{t} {shift}").alias(t), F.expr(f"{bucket_} {'-' if ahead else '+'} {steps}").alias(bucket_), *[F.col(s).alias(f) for s, f in zip(sums, fars)]
        )
        rows = rows.unionByName(whole, allowMissingColumns=True).unionByName(moved, allowMissingColumns=True)
        later = "range between interval '0.000001' second following and unbounded following"
        frames = [(s, later if ahead else upto) for s in sums] + [(f, upto if ahead else since) for f in fars]
    else:
        frames = [] if ahead else [(s, "range between current row and current row") for s in sums]
    summed = {c: F.expr(f"sum({c}) over ({part} {frame})") for c, frame in frames}
    found = rows.withColumns(summed).where(probe)
    out = []
    for name, s, f in zip(names, sums, fars):
        total = near.select(F.sum(s)).schema[0].dataType
        zero = F.lit(0).cast(total)
        terms = [F.coalesce(F.col(c), zero) for c in (s, f) if c in summed]
        value = sum(terms[1:], terms[0]) if terms else zero
        # an interval ahead of no time holds nothing
        out.append((F.when(F.col(t).isNull(), zero).otherwise(value) if ahead else value).cast(total).alias(name))
    return found.select(*[F.col(h).alias(c) for c, h in zip(kept, held)], *out)


def whole_buckets(
    asked: DataFrame | None, near: DataFrame, keys: list[str], sums: list[str], fars: list[str], steps: int, ahead: bool, t: str, bucket: str
) -> DataFrame:
    """A row for each key and bucket with the sums over the buckets wholly inside the interval of any of its times. Its own time is
    null, which sorts first: the running sums of a bucket, of the near part or with ahead of the far one, begin with it. Buckets
    that hold no event but are asked for come from asked."""
    by = [quoted(k) for k in keys]
    if steps == 1:
        return near.limit(0)
    zeros = [F.lit(0).cast(near.schema[s].dataType).alias(s) for s in sums]
    totals = near.drop(t) if asked is None else near.drop(t).unionByName(asked.select(*by, bucket, *zeros))
    totals = totals.where(F.col(bucket).isNotNull()).groupBy(*by, bucket).agg(*[F.sum(s).alias(s) for s in sums])
    inside = f"{1} following and {steps - 1} following" if ahead else f"{steps - 1} preceding and {1} preceding"
    over = f"over (partition by {sql_names(keys)} order by {bucket} range between {inside})"
    time = F.lit(None).cast(near.schema[t].dataType).alias(t)
    return totals.select(*by, time, bucket, *[F.expr(f"sum({s}) {over}").alias(f if ahead else s) for s, f in zip(sums, fars)])
