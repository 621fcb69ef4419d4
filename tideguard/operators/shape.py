"""Detectors on the distribution of a feature, and on deviations from a moving baseline.

zscore, ewma and cusum take window rates and treat a missing window as absent; run dense_grid first where silence counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tideguard.functions.columns import listed, names, quoted
from tideguard.functions.time import interval, micros, window_start
from tideguard.operators.buckets import bucket_at


def entropy_by_window(df: DataFrame, feature: str, size: str, time_col: str = "ts") -> DataFrame:
    """O19. Shannon entropy of a feature's values in each window, in bits, and divided by its maximum; 0 for a single value.

    H = log2(N) - sum(n log2 n) / N needs only sums over the counts, so no window is gathered in a task.
    """
    counts = df.groupBy(window_start(time_col, size).alias("win"), feature).agg(F.count("*").alias("n"))
    sums = counts.groupBy("win").agg(F.sum("n").alias("packets"), F.sum(F.col("n") * F.log2("n")).alias("__s"), F.count("*").alias("n_values"))
    entropy = F.when(F.col("n_values") == 1, F.lit(0.0)).otherwise(F.log2("packets") - F.col("__s") / F.col("packets"))
    sums = sums.withColumn("entropy", entropy)
    most = F.log2(F.col("n_values").cast("double"))
    return sums.withColumn("normalised", F.coalesce(F.try_divide(F.col("entropy"), most), F.lit(0.0))).drop("__s")


def chi2_shift(df: DataFrame, feature: str, size: str, baseline: DataFrame, time_col: str = "ts") -> DataFrame:
    """O20. Pearson's chi-square of each window's mix of a feature against a baseline mix (feature, share).

    Every window has a row: packets are its records in categories of the baseline, on which chi2 is taken (0 without any), and
    outside is how many others it has, null values included; look at both, as a category that the baseline lacks has no
    expected number. A category of the baseline that a window lacks counts as 0: with t records, sum over categories of
    (n - qt)^2 / (qt) is sum(n^2 / (qt)) - 2 n + t over those present, as shares sum to 1. So no grid of windows and
    categories is built.
    """
    mix = baseline.where("share > 0").select(feature, "share")
    counts = df.groupBy(window_start(time_col, size).alias("win"), feature).agg(F.count("*").alias("n"))
    known = F.when(F.col("share").isNotNull(), F.col("n")).otherwise(F.lit(0))
    squares = F.sum(F.col("n") * F.col("n") / F.col("share"))
    sums = counts.join(mix, feature, "left").groupBy("win").agg(F.sum(known).alias("packets"), squares.alias("__s"), (F.sum("n") - F.sum(known)).alias("outside"))
    chi2 = F.coalesce(F.try_divide(F.col("__s"), F.col("packets")) - F.col("packets"), F.lit(0.0))
    return sums.select("win", "packets", chi2.alias("chi2"), "outside")


def baseline_mix(df: DataFrame, feature: str) -> DataFrame:
    """A feature's shares over a table, as chi2_shift's baseline."""
    counts = df.where(F.col(feature).isNotNull()).groupBy(feature).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select(feature, (F.col("n") / F.lit(float(total))).alias("share"))


def dense_grid(rates: DataFrame, keys: str | Sequence[str], step: str, value: str = "packets") -> DataFrame:
    """O21. A row for every window from a key's first to its last, 0 where it is silent."""
    spans = rates.groupBy(*listed(keys)).agg(F.min("win").alias("lo"), F.max("win").alias("hi"))
    grid = spans.select(*listed(keys), F.explode(F.expr(f"sequence(lo, hi, {interval(step)})")).alias("win"))
    return grid.join(rates.select(*listed(keys), "win", value), [*listed(keys), "win"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def zscore(rates: DataFrame, keys: str | Sequence[str], n_prev: int, value: str = "packets") -> DataFrame:
    """O22. (value - mean) / sd over the n_prev windows before; rows without that many, or with sd 0, are left out."""
    frame = f"partition by {names(keys)} order by win rows between {int(n_prev)} preceding and 1 preceding"
    known = rates.selectExpr("*", f"count(1) over ({frame}) as __n", f"avg(`{value}`) over ({frame}) as mean_prev", f"stddev_samp(`{value}`) over ({frame}) as sd_prev")
    known = known.where((F.col("__n") == n_prev) & (F.col("sd_prev") > 0))
    return known.withColumn("z", (F.col(value) - F.col("mean_prev")) / F.col("sd_prev")).drop("__n")


def ewma(rates: DataFrame, keys: str | Sequence[str], alpha: float, horizon: int = 100, value: str = "packets") -> DataFrame:
    """O23. e1 = x1, et = alpha xt + (1 - alpha) e(t-1) over the last horizon windows; each row holds that many values."""
    frame = f"partition by {names(keys)} order by win rows between {int(horizon) - 1} preceding and current row"
    series = F.expr(f"collect_list(cast(`{value}` as double)) over ({frame})")
    a = F.lit(float(alpha))
    held = rates.withColumn("__x", series)
    rest = F.slice("__x", F.lit(2), F.size("__x"))
    return held.withColumn("ewma", F.aggregate(rest, F.element_at("__x", 1), lambda e, x: a * x + (F.lit(1.0) - a) * e)).drop("__x")


#: Length of the time blocks that a series is cut into by default, and how far powers of 1 - alpha may fall in one block.
BLOCK, LEAST_POWER = "1 week", 1e-250


def carried(parts: DataFrame, keys: list[str], order: Sequence[str], step: Callable[[float, float, float], float]) -> DataFrame:
    """parts (one row a key and block, with numbers first, a and b) with start, the state before each block: null until a block has a
    first, then step(start, a, b) of the block before, where its own start is its first if that was null. A key's blocks, not
    its rows, come together in a task."""
    columns = parts.columns

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        state, starts = None, []
        for first, a, b in zip(*(rows.column(c).to_pylist() for c in ("first", "a", "b")), strict=True):
            starts.append(state)
            state = first if state is None else state
            state = None if state is None else step(state, a, b)
        return rows.append_column("start", pa.array(starts, pa.float64()))

    schema = StructType([*parts.schema.fields, StructField("start", DoubleType())])
    return parts.groupBy(*keys).applyInArrow(run, schema).select(*columns, "start")


def in_blocks(rates: DataFrame, keys: Sequence[str], value: str, block: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """rates with names that can't clash: key for the keys, c0... for all columns, x (the value), win and block; the name of the
    key, which is never null, so that joins on it are plain; and what gives the columns their names back, beside new ones."""
    by, held = ["key"], [f"c{i}" for i in range(len(rates.columns))]
    key = F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key")
    plain = rates.select(key, *[quoted(c).alias(h) for c, h in zip(rates.columns, held)], quoted(value).cast("double").alias("x"), F.col("win"))
    plain = plain.withColumn("block", bucket_at(plain, "win", micros(block)))

    def back(df: DataFrame, **new: Column) -> DataFrame:
        return df.select(*[F.col(h).alias(c) for c, h in zip(rates.columns, held) if c not in new], *[x.alias(n) for n, x in new.items()])

    return plain, by, back


def matched(rows: DataFrame, starts: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with start (where a block's own first value stands in for none) and before (null for none) of their key and block."""
    return rows.join(starts.select(*by, F.coalesce("start", "first").alias("start"), F.col("start").alias("before")), list(by))


def cusum_blocks(rates: DataFrame, keys: str | Sequence[str], drift: float, limit: float, value: str = "packets", block: str = BLOCK) -> DataFrame:
    """O24 for long series: cusum, with a key's windows dealt over tasks by time blocks, and sums that restart at each block.

    A block turns the sum S before it into max(S + a, b), where a is the sum of its x - drift and b the largest sum of its last
    ones; these pairs are carried from block to block, and each block's rows then start from their own S. So one key is many tasks'
    work, and a long series of fractions keeps its digits. Equal windows of a key are added by ascending value; a null value leaves
    the sum as it is; rows without a window are left out. Columns may have any name; cusum and alert are replaced.
    """
    rows, by, back = in_blocks(rates, listed(keys), value, block)
    over = f"over (partition by {names([*by, 'block'])} order by win, x rows between unbounded preceding and current row)"
    rows = rows.withColumn("p", F.expr(f"sum(coalesce(x - {float(drift)}D, 0D)) {over}"))
    parts = rows.groupBy(*by, "block").agg(F.sum(F.coalesce(F.col("x") - F.lit(float(drift)), F.lit(0.0))).alias("a"), F.min("p").alias("low"))
    parts = parts.withColumn("b", F.greatest(F.col("a") - F.col("low"), F.lit(0.0))).withColumn("first", F.lit(0.0))
    starts = carried(parts, by, ["block"], lambda s, a, b: max(s + a, b))
    rows = rows.withColumn("low", F.expr(f"min(p) {over}"))
    found = matched(rows, starts, [*by, "block"]).withColumn("sum", F.greatest(F.col("start") + F.col("p"), F.col("p") - F.col("low")))
    return back(found, cusum=F.col("sum"), alert=F.col("sum") >= limit)


def ewma_blocks(rates: DataFrame, keys: str | Sequence[str], alpha: float, value: str = "packets", block: str = BLOCK) -> DataFrame:
    """O23 without a horizon: e1 = x1, et = alpha xt + (1 - alpha) e(t-1) over a key's whole series.

    A block turns the average e before it into a e + b; these pairs are carried from block to block, so a row holds no list and one key is many tasks' work. A time
    block is cut again before powers of 1 - alpha leave the range of doubles. Null values are passed over, and rows
    before a key's first value have none; rows without a window are left out. Equal windows of a key go by ascending value. Columns may have any name; ewma is replaced.
    """
    if not 0 < alpha <= 1:
        raise ValueError(alpha)
    rest = 1 - float(alpha)
    rows, by, back = in_blocks(rates, listed(keys), value, block)
    over = f"over (partition by {names([*by, 'block'])} order by win, x nulls last rows between unbounded preceding and current row)"
    # the values of a block so far, and which part of it a row is in
    length = max(1, int(log(LEAST_POWER) / log(rest))) if 0 < rest else 1
    rows = rows.withColumn("i", F.expr(f"count(x) {over}")).withColumn("part", F.expr(f"cast(floor(greatest(i - 1, 0) / {length}) as bigint)"))
    rows = rows.withColumn("i", F.expr(f"i - part * {length}"))
    inside = f"over (partition by {names([*by, 'block', 'part'])} order by win, x nulls last rows between unbounded preceding and current row)"
    power = f"pow({rest!r}D, {{}})"
    scaled = f"{float(alpha)!r}D * x * {power.format('-i')}"
    rows = rows.withColumn("p", F.expr(f"sum({scaled}) {inside}" if rest else f"last(x, true) {inside}"))
    parts = rows.groupBy(*by, "block", "part").agg(F.max("i").alias("n"), F.max_by("p", "i").alias("p"), F.min_by("x", F.when(F.col("x").isNotNull(), F.col("i"))).alias("first"))
    # a part without values is the map e -> e
    parts = parts.withColumn("a", F.expr(power.format("n")) if rest else F.when(F.col("n") > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    parts = parts.withColumn("b", F.coalesce(F.col("a") * F.col("p") if rest else F.col("p"), F.lit(0.0)))
    found = matched(rows, carried(parts, by, ["block", "part"], lambda e, a, b: a * e + b), [*by, "block", "part"])
    average = F.expr(power.format("i")) * (F.col("start") + F.col("p")) if rest else F.col("p")
    return back(found, ewma=F.when(F.col("i") > 0, average).otherwise(F.col("before")))


def cusum(rates: DataFrame, keys: str | Sequence[str], drift: float, limit: float, value: str = "packets") -> DataFrame:
    """O24. St = max(0, S(t-1) + xt - drift), and alert where St >= limit.

    In closed form: with P the running sum of x - drift, St = Pt - min(0, least P so far). Very long series of fractions
    lose digits in P; restart them by period, or use whole numbers.
    """
    order = f"partition by {names(keys)} order by win rows between unbounded preceding and current row"
    summed = rates.withColumn("__p", F.expr(f"sum(`{value}` - {float(drift)}D) over ({order})"))
    low = summed.withColumn("__low", F.expr(f"min(__p) over ({order})"))
    return low.withColumn("cusum", F.col("__p") - F.least(F.lit(0.0), F.col("__low"))).withColumn("alert", F.col("cusum") >= limit).drop("__p", "__low")
