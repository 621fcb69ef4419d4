"""Sessions, flow features, and from alerts to scored and evaluated incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.functions.columns import listed, names
from tideguard.functions.time import elapsed, interval, micros
from tideguard.operators.buckets import bucket_at


def sessionize(df: DataFrame, keys: str | Sequence[str], gap: str, time_col: str = "ts", bytes_col: str | None = None) -> DataFrame:
    """O28. Records of a key no further apart than gap; exactly gap still joins. end is the last record's time plus gap.

    Records in one time bucket as long as the gap are in one session, so they're summed first, partly where they are read; a
    key then has a row a bucket, however hot it is, and these are merged. Records without a time are left out.
    """
    keys = listed(keys)
    total = F.sum(F.col(bytes_col) if bytes_col else F.lit(0))
    timed = df.where(F.col(time_col).isNotNull())
    times = F.min(time_col).alias("start"), F.max(time_col).alias("__last")
    parts = timed.groupBy(*keys, bucket_at(timed, time_col, max(micros(gap), 1)).alias("__bucket")).agg(*times, F.count("*").alias("packets"), total.alias("bytes"))
    order = f"partition by {names(keys)} order by __bucket"
    flagged = parts.withColumn("__new", F.expr(f"case when start <= lag(__last) over ({order}) + {interval(gap)} then 0 else 1 end"))
    numbered = flagged.withColumn("__n", F.expr(f"sum(__new) over ({order} rows unbounded preceding)"))
    end = (F.max("__last") + F.expr(interval(gap))).alias("end")
    return numbered.groupBy(*keys, "__n").agg(F.min("start").alias("start"), end, F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")).drop("__n")


def spread(sums: str, counts: str, means: str, deviations: str, mean: str) -> Column:
    """The sample deviation of a whole from its parts' counts, means and sums of squared deviations."""
    n = F.sum(counts)
    between = F.sum(F.col(counts) * F.pow(F.col(means) - F.col(mean), F.lit(2)))
    squares = F.coalesce(F.sum(deviations), F.lit(0.0)) + F.coalesce(between, F.lit(0.0))
    return F.when(n > 1, F.sqrt(squares / (n - 1))).alias(sums)


def flow_features(df: DataFrame, keys: str | Sequence[str], bytes_col: str = "bytes", time_col: str = "ts", order_col: str = "record_id", bucket: str = "1 hour") -> DataFrame:
    """O29. Each flow's records, sizes, duration, and mean and deviation of the seconds between its records.

    A flow's records are dealt over tasks by time buckets; a bucket is summed up with its first and last time, and the gaps
    between buckets are added. Records without a time have no gap before or after them.
    """
    keys = listed(keys)
    at = df.withColumn("__bucket", bucket_at(df, time_col, micros(bucket)))
    by = f"partition by {names(keys)}, __bucket"
    gaps = at.withColumn("__previous", F.expr(f"lag(`{time_col}`) over ({by} order by `{time_col}`, `{order_col}`)")).withColumn("__gap", elapsed("__previous", time_col))
    value = F.col(bytes_col)
    parts = gaps.groupBy(*keys, "__bucket").agg(
        F.count("*").alias("packets"),
        F.sum(value).alias("__sum"),
        F.count(value).alias("__n"),
        F.avg(value).alias("__mean"),
        (F.var_pop(value) * F.count(value)).alias("__m2"),
        F.min(value).alias("__min"),
        F.max(value).alias("__max"),
        F.min(time_col).alias("__first"),
        F.max(time_col).alias("__last"),
        F.count("__gap").alias("__gaps"),
        F.avg("__gap").alias("__gap_mean"),
        (F.var_pop("__gap") * F.count("__gap")).alias("__gap_m2"),
    )
    parts = parts.withColumn("__before", F.expr(f"lag(__last) over (partition by {names(keys)} order by __bucket)")).withColumn("__step", elapsed("__before", "__first"))
    whole = f"over (partition by {names(keys)})"
    steps = parts.withColumn("__all", F.expr(f"sum(coalesce(__gap_mean * __gaps, 0) + coalesce(__step, 0)) {whole}"))
    steps = steps.withColumn("__count", F.expr(f"sum(__gaps + if(__step is null, 0, 1)) {whole}"))
    steps = steps.withColumn("__mid", F.try_divide("__all", "__count")).withColumn("__centre", F.expr(f"try_divide(cast(sum(__sum) {whole} as double), sum(__n) {whole})"))
    # a gap between buckets is a part of one value
    stepped = F.when(F.col("__step").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    inner = F.struct(F.col("__gaps").alias("n"), F.col("__gap_mean").alias("mean"), F.col("__gap_m2").alias("m2"), F.lit(True).alias("own"))
    outer = F.struct(stepped.alias("n"), F.col("__step").alias("mean"), F.lit(0.0).alias("m2"), F.lit(False).alias("own"))
    each = steps.withColumn("__part", F.explode(F.array(inner, outer)))
    sizes = [F.when(F.col("__part.own"), F.col(c)).alias(c) for c in ("packets", "__sum", "__n", "__mean", "__m2", "__min", "__max")]
    gap_parts = [F.col(f"__part.{c}").alias(f"__part_{c}") for c in ("n", "mean", "m2")]
    each = each.select(*keys, "__mid", "__centre", "__all", "__count", *gap_parts, *sizes)
    return each.groupBy(*keys).agg(
        F.sum("packets").alias("packets"),
        F.sum("__sum").alias("bytes"),
        F.min("__min").alias("min_bytes"),
        F.max("__max").alias("max_bytes"),
        F.first("__centre").alias("mean_bytes"),
        spread("sd_bytes", "__n", "__mean", "__m2", "__centre"),
        F.first("__mid").alias("mean_gap"),
        spread("sd_gap", "__part_n", "__part_mean", "__part_m2", "__mid"),
        F.first(F.when(F.col("__count") > 0, F.col("__all"))).alias("duration"),
    )


def incidents(alerts: DataFrame, keys: str | Sequence[str], gap: str, value: str = "packets") -> DataFrame:
    """O30. Alert windows of a key whose starts are no further apart than gap, merged: start and end (the first and last
    window), peak and n_windows."""
    order = f"partition by {names(keys)} order by win"
    flagged = alerts.withColumn("__new", F.expr(f"case when win <= lag(win) over ({order}) + {interval(gap)} then 0 else 1 end"))
    numbered = flagged.withColumn("__n", F.expr(f"sum(__new) over ({order} rows unbounded preceding)"))
    merged = numbered.groupBy(*listed(keys), "__n").agg(F.min("win").alias("start"), F.max("win").alias("end"), F.max(value).alias("peak"), F.count("*").alias("n_windows"))
    return merged.drop("__n")


def combine_alerts(*alerts: DataFrame, on: Sequence[str] = ("win", "key")) -> DataFrame:
    """O31. Alerts of several detectors, each with on, rule and weight: score (a rule counts once, with its largest weight)
    and the rules fired, in order."""
    if not alerts:
        raise ValueError("no alerts")
    together = alerts[0].select(*on, "rule", "weight")
    for more in alerts[1:]:
        together = together.unionByName(more.select(*on, "rule", "weight"))
    once = together.groupBy(*on, "rule").agg(F.max("weight").alias("weight"))
    rules = F.concat_ws(",", F.sort_array(F.collect_list("rule")))
    return once.groupBy(*on).agg(F.sum("weight").alias("score"), F.count("*").alias("n_rules"), rules.alias("rules"))


def evaluate_alerts(alerts: DataFrame, truth: DataFrame, on: Sequence[str] = ("win", "key")) -> DataFrame:
    """O32. tp, fp, fn, precision, recall and f1 of alerts against known attacks; a ratio over 0 is null."""
    found = alerts.select(*on).distinct().withColumn("__a", F.lit(True))
    known = truth.select(*on).distinct().withColumn("__t", F.lit(True))
    both = found.join(known, list(on), "full_outer")
    a, t = F.col("__a").isNotNull(), F.col("__t").isNotNull()
    counts = both.agg(F.count_if(a & t).alias("tp"), F.count_if(a & ~t).alias("fp"), F.count_if(~a & t).alias("fn"))
    tp = F.col("tp").cast("double")
    scores = {"precision": F.try_divide(tp, F.col("tp") + F.col("fp")), "recall": F.try_divide(tp, F.col("tp") + F.col("fn"))}
    return counts.withColumns(scores | {"f1": F.try_divide(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
