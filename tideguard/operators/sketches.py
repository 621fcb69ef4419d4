"""Sketches that are stored a window and merged over longer spans, so that no raw record is read or summed twice.

Each has three steps: sketches of short windows, which are partial where records are read; merging, which moves sketches alone;
and an estimate. A stored table of sketches answers for any span that its windows make up.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.functions.columns import listed, quoted, weight
from tideguard.functions.time import micros, window_start


def divides(part: str, whole: str) -> None:
    if not micros(part) or micros(whole) % micros(part):
        raise ValueError(f"{whole} is not made of windows of {part}")


# --- most frequent keys -----------------------------------------------------------------------------------------------


def top_sketches(df: DataFrame, key: str, size: str, max_items: int = 10_000, time_col: str = "ts") -> DataFrame:
    """O14. A sketch of the most frequent keys of each window (win, sketch), which tracks max_items keys. Null keys count as one key."""
    return df.groupBy(window_start(time_col, size).alias("win")).agg(F.expr(f"approx_top_k_accumulate(`{key}`, {int(max_items)})").alias("sketch"))


def merged_top(sketches: DataFrame, key: str, k: int, size: str | None = None, max_items: int = 10_000) -> DataFrame:
    """O14. The k most frequent keys of each longer window, or of all (win is then the first window's), from top_sketches: win,
    key and packets, exact as long as no sketch holds more keys than it tracks, else an estimate."""
    # a constant group has no row where there is no sketch
    groups = window_start("win", size).alias("win") if size else F.lit(1).alias("all")
    first = [] if size else [F.min("win").alias("win")]
    merged = sketches.groupBy(groups).agg(F.expr(f"approx_top_k_combine(sketch, {int(max_items)})").alias("sketch"), *first).where("sketch is not null")
    top = merged.select("win", F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(k)})")).alias("top"))
    return top.select("win", F.col("top.item").alias(key), F.col("top.count").alias("packets"))


# --- how often any key occurs -----------------------------------------------------------------------------------------


def shape_of(error: float, confidence: float) -> tuple[int, int]:
    """Rows and cells a row: an estimate is above the truth by more than error * volume with a probability of 1 - confidence at most."""
    return max(1, ceil(-log2(1 - confidence))), max(1, ceil(2 / error))


def cell(keys: Sequence[str], row: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(row, *[quoted(k) for k in keys]), F.lit(width))


def count_sketches(
    df: DataFrame, keys: str | Sequence[str], size: str, error: float = 0.001, confidence: float = 0.99, time_col: str = "ts", packets: str | None = None
) -> DataFrame:
    """O14. A count-min sketch of each window, as a table of its cells that aren't 0: win, row, cell and packets. A window has at most
    as many as shape_of says, however many keys there are. Numbers of packets must not be negative; a null one counts 0."""
    depth, width = shape_of(error, confidence)
    amount = F.coalesce(weight(packets), F.lit(0))
    placed = df.select(window_start(time_col, size).alias("win"), *[quoted(k).alias(f"k{i}") for i, k in enumerate(listed(keys))], amount.alias("packets"))
    placed = placed.where("win is not null").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    by = [f"k{i}" for i in range(len(listed(keys)))]
    return placed.groupBy("win", "row", cell(by, F.col("row"), width).alias("cell")).agg(F.sum("packets").alias("packets"))


def merged_counts(sketches: DataFrame, size: str) -> DataFrame:
    """O14. The sketches of longer windows: cells add up."""
    return sketches.groupBy(window_start("win", size).alias("win"), "row", "cell").agg(F.sum("packets").alias("packets"))


def point_estimates(sketches: DataFrame, wanted: DataFrame, keys: str | Sequence[str], error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """O14. For each (win, keys) in wanted, from sketches of that shape: estimate (never below the true number) and bound (the estimate
    is above it by more than this with a probability of 1 - confidence at most). Repeated rows are one row; 0 where the window holds nothing."""
    keys = listed(keys)
    depth, width = shape_of(error, confidence)
    asked = wanted.select("win", *[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).distinct()
    by = [f"k{i}" for i in range(len(keys))]
    placed = asked.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("cell", cell(by, F.col("row"), width))
    # one row of a sketch holds a window's whole volume
    volume = sketches.where("row = 0").groupBy("win").agg(F.sum("packets").alias("volume"))
    zero = F.lit(0).cast(sketches.schema["packets"].dataType)
    found = placed.join(sketches, ["win", "row", "cell"], "left").groupBy("win", *by).agg(F.min(F.coalesce("packets", zero)).alias("estimate"))
    found = found.join(volume, "win", "left").withColumn("bound", F.coalesce("volume", zero) * F.lit(float(error)))
    return found.select("win", *[F.col(b).alias(k) for b, k in zip(by, keys)], "estimate", "bound")


# --- distinct peers ---------------------------------------------------------------------------------------------------


def peer_sketches(df: DataFrame, key: str | Sequence[str], peer: str, slide: str, lg: int = 14, time_col: str = "ts") -> DataFrame:
    """O15. A HyperLogLog sketch of the peers of each key and window of length slide: win, key and sketch, of 2^lg cells at most. Null
    peers don't count."""
    kinds = ("string", "binary", "int", "bigint")
    value = quoted(peer) if dict(df.dtypes)[peer] in kinds else quoted(peer).cast("string")
    return df.groupBy(window_start(time_col, slide).alias("win"), *listed(key)).agg(F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"))


def merged_peers(sketches: DataFrame, key: str | Sequence[str], size: str, slide: str | None = None) -> DataFrame:
    """O15. Distinct peers of each key in windows of a size that sketches of length slide make up, sliding by that length or, without
    one, tumbling: win, key and peers. A record is in one sketch, and only sketches are repeated for the windows that they belong to."""
    if slide:
        divides(slide, size)
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(window_start("win", size, slide).alias("win"), *listed(key)).agg(F.coalesce(union, F.lit(0).cast("bigint")).alias("peers"))


# --- quantiles --------------------------------------------------------------------------------------------------------


def rate_sketches(rates: DataFrame, keys: str | Sequence[str], period: str, value: str = "packets", k: int = 200) -> DataFrame:
    """O11. A KLL sketch of the values of each key's windows in each period: win (the period's start), keys and sketch. The value
    must be a whole number; null ones don't count."""
    sketch = F.kll_sketch_agg_bigint(quoted(value).cast("bigint"), F.lit(int(k)))
    return rates.where(quoted(value).isNotNull()).groupBy(window_start("win", period).alias("win"), *listed(keys)).agg(sketch.alias("sketch"))


def merged_quantile(sketches: DataFrame, keys: str | Sequence[str], q: float, size: str | None = None) -> DataFrame:
    """O11. Each key's limit over all periods, or with a size over each longer one (win): the least value whose share of values up to it
    is at least q, exact for as many values as a sketch keeps (k), else with an error of rank of about 1.3 % at k = 200."""
    groups = [window_start("win", size).alias("win")] if size else []
    merged = sketches.groupBy(*groups, *listed(keys)).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    limit, n = F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))), F.kll_sketch_get_n_bigint("sketch")
    return merged.select(*(["win"] if size else []), *listed(keys), limit.alias("limit"), n.alias("n_windows"))
