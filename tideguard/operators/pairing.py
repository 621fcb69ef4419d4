"""Pairing requests with responses: equi-joins on a key with the interval as a further condition, or sums without pairs.

With bucket given, the key is extended by a time bucket of that span, which spreads a key that holds most of the
traffic: a request is repeated for the buckets that its interval touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.functions.columns import listed
from tideguard.functions.time import interval, micros
from tideguard.operators.buckets import sums_within


def bucket_of(column: str, span: str) -> Column:
    at = F.expr(f"timestampdiff(MICROSECOND, cast('1970-01-01' as timestamp_ntz), cast(`{column}` as timestamp_ntz))")
    step = F.lit(micros(span)).cast("bigint")
    return ((at - F.pmod(at, step)) / step).cast("bigint")


def prefixed(df: DataFrame, on: Sequence[str], prefix: str) -> DataFrame:
    """Every column but the keys gets the prefix, so the two sides' names can't clash."""
    return df.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in on])


def sides(req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, time_col: str, bucket: str | None):
    on = listed(on)
    a, b = prefixed(req, on, "req_"), prefixed(resp, on, "resp_")
    r, s = f"req_{time_col}", f"resp_{time_col}"
    in_time = (F.col(s) > F.col(r)) & (F.col(s) <= F.col(r) + F.expr(interval(within)))
    return on, a, b, r, s, in_time


def match_responses(req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, time_col: str = "ts", bucket: str | None = None) -> DataFrame:
    """O25. Pairs with req.ts < resp.ts <= req.ts + within; columns are prefixed req_ and resp_."""
    on, a, b, r, s, in_time = sides(req, resp, on, within, time_col, bucket)
    keys = on
    if bucket is not None:
        end = F.col(r) + F.expr(interval(within))
        a = a.withColumn("__end", end).withColumn("__bucket", F.explode(F.sequence(bucket_of(r, bucket), bucket_of("__end", bucket)))).drop("__end")
        b = b.withColumn("__bucket", bucket_of(s, bucket))
        keys = [*on, "__bucket"]
    joined = a.join(b, keys).where(in_time)
    return joined.drop("__bucket") if bucket is not None else joined


def unanswered(req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, time_col: str = "ts", id_cols: str | Sequence[str] | None = None, bucket: str | None = None) -> DataFrame:
    """O26. Requests without any response in time. With a bucket, id_cols, which must not be null, tell requests apart."""
    if bucket is not None and not listed(id_cols or []):
        raise ValueError("unanswered with a bucket needs id_cols")
    on, a, b, r, s, in_time = sides(req, resp, on, within, time_col, bucket)
    if bucket is not None:
        ids = listed(id_cols or [])
        answered = match_responses(req, resp, on, within, time_col, bucket).select(*[F.col(f"req_{c}").alias(c) for c in ids]).distinct()
        return req.join(answered, ids, "left_anti")
    left, right = a.alias("a"), b.alias("b")
    same = F.lit(True)
    for k in on:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    found = left.join(right, same & in_time, "left_anti")
    return found.select(*[F.col(c if c in on else f"req_{c}").alias(c) for c in req.columns])


def amplification_factor(
    req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, bytes_col: str = "bytes", id_col: str = "record_id", time_col: str = "ts", bucket: str | None = None
) -> DataFrame:
    """O27. Response bytes over request bytes for each request: 0 if unanswered, null if the request has 0 bytes.

    A response in several requests' intervals counts for each of them. No pair is made: requests meet running sums of the
    responses, dealt by time buckets (sums_within). A null key is never answered; repeated requests are rows of their own.
    """
    keys = listed(on)
    asked = req.select(id_col, *keys, time_col, F.col(bytes_col).alias("request_bytes"))
    answers = resp.where(" and ".join(f"`{c}` is not null" for c in [*keys, time_col]))
    sums = {"response_bytes": F.col(bytes_col), "responses": F.lit(1).cast("bigint")}
    both = sums_within(asked, answers, keys, within, sums, ahead=True, time_col=time_col, bucket=bucket).drop(time_col)
    return both.withColumn("factor", F.try_divide(F.col("response_bytes").cast("double"), F.col("request_bytes")))
