"""Rates per key and window, thresholds on them, and heavy hitters.

Every aggregate is partial before its shuffle, so a key that is under attack, and may be most of the table, is summed
where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.functions.columns import listed, names, ratio, weight
from tideguard.functions.time import micros, seconds, window_start
from tideguard.operators.buckets import sums_within


def rate_by_window(
    df: DataFrame, keys: str | Sequence[str], size: str, slide: str | None = None, time_col: str = "ts", packets: str | None = None, bytes_col: str | None = None
) -> DataFrame:
    """O8. packets, bytes (0 without a bytes column) and their rates a second, by window start and key.

    Sliding windows whose size is a multiple of the slide are summed from tumbling ones, so a record is repeated
    for its windows only after it has been summed.
    """
    sums = [F.sum(weight(packets)).alias("packets"), F.sum(F.col(bytes_col) if bytes_col else F.lit(0)).alias("bytes")]
    if slide is not None and micros(size) % micros(slide) == 0:
        parts = df.groupBy(window_start(time_col, slide).alias("__part"), *listed(keys)).agg(*sums)
        rates = parts.groupBy(window_start("__part", size, slide).alias("win"), *listed(keys)).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    else:
        rates = df.groupBy(window_start(time_col, size, slide).alias("win"), *listed(keys)).agg(*sums)
    span = float(seconds(size))
    return rates.withColumns({"packet_rate": F.col("packets") / span, "byte_rate": F.col("bytes") / span})


def trailing_rate(df: DataFrame, keys: str | Sequence[str], span: str, time_col: str = "ts", packets: str | None = None, bucket: str | None = None) -> DataFrame:
    """O9. For each record the packets of its key in [time - span, time], as trailing.

    The work of a key is dealt over tasks by time buckets (sums_within), each a divisor of the span and at most bucket if that
    is given. A null time counts the key's records without one; a null number of packets counts 0; a span of 0 counts equal times.
    """
    return sums_within(df, df, keys, span, {"trailing": weight(packets)}, ahead=False, time_col=time_col, bucket=bucket)


def rate_threshold(df: DataFrame, keys: str | Sequence[str], size: str, max_packets: float | None = None, max_bytes: float | None = None, **columns: str) -> DataFrame:
    """O10. Windows at or above a fixed limit of packets or bytes."""
    rates = rate_by_window(df, keys, size, **columns)
    over = F.lit(False)
    if max_packets is not None:
        over = over | (F.col("packets") >= max_packets)
    if max_bytes is not None:
        over = over | (F.col("bytes") >= max_bytes)
    return rates.where(over)


def quantile_threshold(df: DataFrame, keys: str | Sequence[str], size: str, q: float, accuracy: int | None = None, **columns: str) -> DataFrame:
    """O11. Each key's limit: the q-quantile of its window counts; approximate, in bounded memory, if accuracy is given."""
    rates = rate_by_window(df, keys, size, **columns)
    limit = F.percentile("packets", F.lit(q)) if accuracy is None else F.percentile_approx("packets", q, accuracy).cast("double")
    return rates.groupBy(*listed(keys)).agg(limit.alias("limit"), F.count("*").alias("n_windows"))


def top_talkers(df: DataFrame, key: str | Sequence[str], size: str, k: int, **columns: str) -> DataFrame:
    """O12. The k keys with most packets in each window, ties by key; rank from 1. Spark limits groups before the shuffle."""
    rates = rate_by_window(df, key, size, **columns).select("win", *listed(key), "packets")
    rank = F.expr(f"row_number() over (partition by win order by packets desc, {names(key)})")
    return rates.withColumn("rank", rank).where(F.col("rank") <= k)


def heavy_hitters(df: DataFrame, key: str | Sequence[str], size: str, phi: float, **columns: str) -> DataFrame:
    """O13. Keys that hold at least a share phi of a window's packets. Totals are summed a window and joined, so no window's
    keys are gathered in a task."""
    rates = rate_by_window(df, key, size, **columns).select("win", *listed(key), "packets")
    totals = rates.groupBy("win").agg(F.sum("packets").alias("__total"))
    return rates.join(totals, "win").withColumn("share", ratio(F.col("packets"), F.col("__total"))).drop("__total").where(F.col("share") >= phi)


def approx_top_talkers(df: DataFrame, key: str, k: int, max_items: int = 10_000) -> DataFrame:
    """O14. The k most frequent keys by a bounded sketch, with estimated counts."""
    top = df.agg(F.expr(f"approx_top_k(`{key}`, {int(k)}, {int(max_items)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key), F.col("t.count").alias("packets"))


def distinct_peers(df: DataFrame, key: str | Sequence[str], peer: str, size: str, rsd: float | None = None, time_col: str = "ts") -> DataFrame:
    """O15. Fan-in or fan-out: distinct peers of each key and window, exact or, with rsd, by HyperLogLog."""
    count = F.count_distinct(F.col(peer)) if rsd is None else F.approx_count_distinct(peer, rsd)
    return df.groupBy(window_start(time_col, size).alias("win"), *listed(key)).agg(count.alias("peers"))


def new_sources(df: DataFrame, src: str | Sequence[str], size: str, time_col: str = "ts") -> DataFrame:
    """O16. How many sources are first seen in each window; windows without any are absent."""
    first = df.groupBy(*listed(src)).agg(F.min(time_col).alias("first_ts"))
    return first.groupBy(window_start("first_ts", size).alias("win")).agg(F.count("*").alias("new_sources"))


def ratio_by_window(df: DataFrame, keys: str | Sequence[str], size: str, num_pred: str, den_pred: str, time_col: str = "ts") -> DataFrame:
    """O17. Records that satisfy one predicate over those that satisfy another; null where there are none of these."""
    counts = df.groupBy(window_start(time_col, size).alias("win"), *listed(keys)).agg(F.count_if(F.expr(num_pred)).alias("num"), F.count_if(F.expr(den_pred)).alias("den"))
    return counts.withColumn("ratio", ratio(F.col("num"), F.col("den")))


def rollup_traffic(df: DataFrame, dims: Sequence[str], packets: str | None = None, bytes_col: str | None = None) -> DataFrame:
    """O18. Totals at each level of dims, with level = grouping_id."""
    total = F.sum(F.col(bytes_col) if bytes_col else F.lit(0))
    return df.rollup(*listed(dims)).agg(F.sum(weight(packets)).alias("packets"), total.alias("bytes"), F.grouping_id().alias("level"))
