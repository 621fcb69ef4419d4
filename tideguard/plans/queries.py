"""One query an operator, on the events table in the role of traffic, and the SQL that each is compared with.

src = user_id, dst = event_type, bytes = value, dst_port from props, record_id = event_id; src_ip is made up of ids.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.operators import pairing, prepare, rates, sessions, shape, sightings, sketches
from tideguard.sources import traffic
from tideguard.streaming import detect

MAPPING = {
    "ts": "ts",
    "src": "user_id",
    "dst": "event_type",
    "bytes": "value",
    "dst_port": "cast(get_json_object(props, '$.k') as int)",
    "record_id": "event_id",
    "src_ip": "(user_id * 28633115 + event_id * 7919) & 4294967295",
}
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.load_traffic(spark, f"{sf_dir}/events.parquet", mapping=MAPPING)


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    return traffic.stream_traffic(spark, f"{sf_dir}/events.parque[t]", schema=EVENTS, mapping=MAPPING)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, or on a local master in a new one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tideguard-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, through the alert sink, and read the sink."""
    spark = df.sparkSession
    path = shared(spark, name)
    schema = df.schema
    traffic.write_alerts(df, path, checkpoint=shared(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(schema).parquet(path)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


T = """with traffic as (select ts, user_id as src, event_type as dst, value as bytes, cast(json_extract_string(props, '$.k') as int) as dst_port,
 event_id as record_id, ((user_id * 28633115 + event_id * 7919) & 4294967295) as src_ip from events),
 day as (select date_trunc('day', ts)::timestamp as win, src, count(*) as packets, sum(bytes) as bytes from traffic group by 1, 2)
"""


@query(T + "select ts, src, dst, bytes, dst_port, record_id, src_ip from traffic")
def o1_load_traffic(spark, sf_dir):
    return events(spark, sf_dir)


@query("select event_id as record_id, user_id as src from events")
def o2_stream_traffic(spark, sf_dir):
    return drained(stream(spark, sf_dir).select("record_id", "src"), "o2")


@query(T + "select win, src, packets from day where packets >= 6")
def o3_write_alerts(spark, sf_dir):
    path = shared(spark, "o3")
    traffic.write_alerts(rates.rate_threshold(events(spark, sf_dir), "src", "1 day", max_packets=6).select("win", "src", "packets"), path)
    return spark.read.schema("win timestamp_ntz, src bigint, packets bigint").parquet(path)


@query(T + "select record_id, ts, src from traffic where ts >= '2024-01-05' and ts < '2024-01-12' and dst = 'error'")
def o4_filter_traffic(spark, sf_dir):
    return prepare.filter_traffic(events(spark, sf_dir), "2024-01-05", "2024-01-12", "dst = 'error'").select("record_id", "ts", "src")


@query(T + "select distinct record_id, src from traffic")
def o5_dedup_records(spark, sf_dir):
    rows = events(spark, sf_dir)
    return prepare.dedup_records(rows.unionByName(rows.where("record_id % 3 = 0")), "record_id").select("record_id", "src")


def building(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("src"))


@query(T + "select record_id, src from traffic where src in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def o6_match_listed(spark, sf_dir):
    return prepare.match_list(events(spark, sf_dir), building(spark, sf_dir), "src").select("record_id", "src")


@query(T + "select record_id, src from traffic where src is null or not exists (select 1 from customer where c_mktsegment = 'BUILDING' and c_custkey = src)")
def o6_match_unlisted(spark, sf_dir):
    return prepare.match_list(events(spark, sf_dir), building(spark, sf_dir), "src", "unlisted").select("record_id", "src")


@query(ORACLES["o6_match_listed"])
def o6_match_large_listed(spark, sf_dir):
    return prepare.match_large_list(events(spark, sf_dir), building(spark, sf_dir), "src").select("record_id", "src")


@query(ORACLES["o6_match_unlisted"])
def o6_match_large_unlisted(spark, sf_dir):
    return prepare.match_large_list(events(spark, sf_dir), building(spark, sf_dir), "src", "unlisted").select("record_id", "src")


def cidr_rules(spark, sf_dir):
    """Every customer as a rule of 8, 12 or 16 bits."""
    plen = "cast(8 + 4 * (c_custkey % 3) as int)"
    pfx = f"shiftright((c_custkey * 2654435761) & 4294967295, 32 - {plen})"
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as rule_id", f"{plen} as plen", f"{pfx} as pfx")


CIDR = (
    T
    + """, rules as (select plen, ((k * 2654435761) & 4294967295) >> (32 - plen) as pfx, min(k) as rule_id from (select c_custkey as k, (8 + 4 * (c_custkey % 3))::int as plen from customer) group by 1, 2),
 hits as (select record_id, src_ip, rule_id, plen from traffic join rules on plen = 8 and src_ip >> 24 = pfx
  union all select record_id, src_ip, rule_id, plen from traffic join rules on plen = 12 and src_ip >> 20 = pfx
  union all select record_id, src_ip, rule_id, plen from traffic join rules on plen = 16 and src_ip >> 16 = pfx)
select record_id, src_ip, rule_id, plen from (select *, row_number() over (partition by record_id order by plen desc) as r from hits) where r = 1"""
)


@query(CIDR)
def o7_cidr_match(spark, sf_dir):
    """Every customer is a rule, and every event is matched."""
    return prepare.cidr_match(events(spark, sf_dir), cidr_rules(spark, sf_dir)).select("record_id", "src_ip", "rule_id", "plen")


@query(CIDR)
def o7_cidr_match_all(spark, sf_dir):
    return prepare.cidr_match(events(spark, sf_dir), cidr_rules(spark, sf_dir)).select("record_id", "src_ip", "rule_id", "plen")


@query(
    T
    + """, addresses as (select record_id, src_ip % 2 as family, case when src_ip % 2 = 0 then '20010DB8' || upper(substr(md5(src::varchar), 1, 8)) || upper(substr(md5(record_id::varchar), 1, 16)) else printf('%08X', src_ip) end as digits from traffic),
 rules as (
  select c_custkey as rule_id, 0 as family, 28 + 4 * (c_custkey % 9) as plen, left('20010DB8' || upper(substr(md5((c_custkey % 200)::varchar), 1, 8)), 7 + c_custkey % 9) as start from customer
  union all
  select c_custkey, 1, 8 + 4 * (c_custkey % 3), left(printf('%08X', (c_custkey * 2654435761) & 4294967295), 2 + c_custkey % 3) from customer),
 best as (select family, plen, start, min(rule_id) as rule_id from rules group by all),
 asked as (select record_id, family, digits, unnest(range(8, 64, 4)) as plen from addresses),
 hits as (select record_id, rule_id, a.plen, row_number() over (partition by record_id order by a.plen desc) as r from asked a join best b on a.family = b.family and a.plen = b.plen and left(digits, a.plen // 4) = start)
select record_id, rule_id, plen::int as plen from hits where r = 1"""
)
def o7_cidr_match_mixed(spark, sf_dir):
    """IPv4 and IPv6 in one column of bytes, against 3,000 rules of 12 lengths at sf0.01 that are nested in one another."""
    even = "src_ip % 2 = 0"
    six = "concat('20010DB8', substring(md5(cast(src as string)), 1, 8), substring(md5(cast(record_id as string)), 1, 16))"
    rows = events(spark, sf_dir).selectExpr("record_id", f"unhex(if({even}, {six}, lpad(hex(src_ip), 8, '0'))) as address")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    net = "rpad(concat('20010DB8', substring(md5(cast(c_custkey % 200 as string)), 1, 8)), 32, '0')"
    rules = customers.selectExpr("c_custkey as rule_id", f"unhex({net}) as pfx", "cast(28 + 4 * (c_custkey % 9) as int) as plen")
    four = customers.selectExpr("c_custkey as rule_id", "unhex(lpad(hex((c_custkey * 2654435761) & 4294967295), 8, '0')) as pfx", "cast(8 + 4 * (c_custkey % 3) as int) as plen")
    return prepare.cidr_match(rows, rules.unionByName(four), "address").select("record_id", "rule_id", "plen")


@query(T + "select win, src, packets, round(bytes, 6) as bytes, round(packets / 86400.0::double, 9) as packet_rate from day")
def o8_rate_by_window(spark, sf_dir):
    return rounded(rounded(rates.rate_by_window(events(spark, sf_dir), "src", "1 day", bytes_col="bytes"), "bytes"), "packet_rate", digits=9).drop("byte_rate")


@query(
    T
    + """, slid as (select unnest([time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - to_hours(6 * i) for i in range(4)]) as win, dst, bytes from traffic)
select win, dst, count(*) as packets, round(sum(bytes), 4) as bytes from slid group by 1, 2"""
)
def o8_rate_sliding(spark, sf_dir):
    return rounded(rates.rate_by_window(events(spark, sf_dir), "dst", "1 day", "6 hours", bytes_col="bytes"), "bytes", digits=4).select("win", "dst", "packets", "bytes")


@query(T + "select record_id, src, count(*) over (partition by src order by ts range between interval '2 days' preceding and current row) as trailing from traffic")
def o9_trailing_rate(spark, sf_dir):
    return rates.trailing_rate(events(spark, sf_dir), "src", "2 days").select("record_id", "src", "trailing")


@query(T + "select win, src, packets, round(bytes, 6) as bytes from day where packets >= 6 or bytes >= 1500")
def o10_rate_threshold(spark, sf_dir):
    found = rates.rate_threshold(events(spark, sf_dir), "src", "1 day", max_packets=6, max_bytes=1500, bytes_col="bytes")
    return rounded(found, "bytes").select("win", "src", "packets", "bytes")


@query(T + 'select src, round(quantile_cont(packets, 0.9), 6) as "limit", count(*) as n_windows from day group by src')
def o11_quantile_threshold(spark, sf_dir):
    return rounded(rates.quantile_threshold(events(spark, sf_dir), "src", "1 day", 0.9), "limit")


@query(T + 'select src, quantile_disc(packets, 0.9) as "limit", count(*) as n_windows from day group by src')
def o11_merged_quantile(spark, sf_dir):
    """Sketches of ten days, merged over all; exact, as a source has fewer days than a sketch keeps values."""
    days = rates.rate_by_window(events(spark, sf_dir), "src", "1 day")
    return sketches.merged_quantile(sketches.rate_sketches(days, "src", "10 days"), "src", 0.9)


@query(T + "select * from (select win, src, packets, row_number() over (partition by win order by packets desc, src)::int as rank from day) where rank <= 5")
def o12_top_talkers(spark, sf_dir):
    return rates.top_talkers(events(spark, sf_dir), "src", "1 day", 5)


@query(T + "select win, src, packets, round(packets / total, 9) as share from (select *, sum(packets) over (partition by win)::double as total from day) where packets / total >= 0.02")
def o13_heavy_hitters(spark, sf_dir):
    return rounded(rates.heavy_hitters(events(spark, sf_dir), "src", "1 day", 0.02), "share", digits=9)


@query()
def o14_approx_top_talkers(spark, sf_dir):
    return rates.approx_top_talkers(events(spark, sf_dir), "src", 10)


@query(T + "select src, count(*) as packets from traffic group by src")
def o14_approx_all_talkers(spark, sf_dir):
    """Exact, as the sketch tracks more keys than there are; with more it would estimate."""
    return rates.approx_top_talkers(events(spark, sf_dir), "src", 100_000, 1_000_000)


@query(T + "select row_number() over (order by packets desc)::int as rank, packets from (select src, count(*) as packets from traffic group by src) qualify rank <= 10")
def o14_approx_top_counts(spark, sf_dir):
    """The counts of the ten most frequent keys, whichever of equal ones is named; exact, as fewer keys than the sketch tracks occur."""
    top = rates.approx_top_talkers(events(spark, sf_dir), "src", 10, 100_000)
    return top.selectExpr("row_number() over (order by packets desc) as rank", "packets")


@query(T + "select date_trunc('day', ts)::timestamp as win, src, count(*) as packets from traffic group by 1, 2")
def o14_merged_top_talkers(spark, sf_dir):
    """Days of 24 hourly sketches; exact, as they track more keys than there are."""
    hours = sketches.top_sketches(events(spark, sf_dir), "src", "1 hour", 100_000)
    return sketches.merged_top(hours, "src", 100_000, "1 day", 100_000)


@query(T + "select win, src, true as within from (select date_trunc('day', ts)::timestamp as win, src from traffic group by 1, 2)")
def o14_point_estimates(spark, sf_dir):
    """Every source of each day in sketches of hours that are merged into days: no estimate is below the true count or above it by more
    than ten times the bound."""
    rows = events(spark, sf_dir)
    days = sketches.merged_counts(sketches.count_sketches(rows, "src", "1 hour", error=0.001, confidence=0.999), "1 day")
    true = rates.rate_by_window(rows, "src", "1 day").select("win", "src", "packets")
    found = true.join(sketches.point_estimates(days, true, "src", error=0.001, confidence=0.999), ["win", "src"])
    within = (F.col("estimate") >= F.col("packets")) & (F.col("estimate") - F.col("packets") <= 10 * F.col("bound"))
    return found.select("win", "src", within.alias("within"))


@query(T + "select date_trunc('day', ts)::timestamp as win, dst, count(distinct src) as peers from traffic group by 1, 2")
def o15_distinct_peers(spark, sf_dir):
    return rates.distinct_peers(events(spark, sf_dir), "dst", "src", "1 day")


@query()
def o15_distinct_peers_approx(spark, sf_dir):
    return rates.distinct_peers(events(spark, sf_dir), "dst", "src", "1 day", rsd=0.02)


@query(T + "select date_trunc('day', ts)::timestamp as win, dst, true as within from traffic group by 1, 2")
def o15_distinct_peers_bound(spark, sf_dir):
    """o15_distinct_peers_approx beside the exact numbers, each within four times the asked deviation."""
    rows = events(spark, sf_dir)
    near = rates.distinct_peers(rows, "dst", "src", "1 day", rsd=0.02)
    exact = rates.distinct_peers(rows, "dst", "src", "1 day").withColumnRenamed("peers", "exact")
    within = F.abs(F.col("peers") - F.col("exact")) <= F.greatest(F.lit(1.0), F.lit(0.08) * F.col("exact"))
    return near.join(exact, ["win", "dst"], "full").select("win", "dst", F.coalesce(within, F.lit(False)).alias("within"))


@query(
    T
    + """, slid as (select unnest([time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - to_hours(6 * i) for i in range(4)]) as win, dst, src from traffic)
select win, dst, true as within from (select distinct win, dst from slid)"""
)
def o15_sliding_peers(spark, sf_dir):
    """Fan-in of sliding days from sketches of six hours, each within 5 % of the exact count."""
    rows = events(spark, sf_dir)
    slides = sketches.peer_sketches(rows, "dst", "src", "6 hours")
    found = sketches.merged_peers(slides, "dst", "1 day", "6 hours")
    exact = rows.groupBy(F.window("ts", "1 day", "6 hours").getField("start").alias("win"), "dst").agg(F.count_distinct("src").alias("exact"))
    within = F.abs(F.col("peers") - F.col("exact")) <= F.lit(0.05) * F.col("exact")
    return found.join(exact, ["win", "dst"], "full").select("win", "dst", F.coalesce(within, F.lit(False)).alias("within"))


@query(T + "select date_trunc('day', first)::timestamp as win, count(*) as new_sources from (select min(ts) as first from traffic group by src) group by 1")
def o16_new_sources(spark, sf_dir):
    return rates.new_sources(events(spark, sf_dir), "src", "1 day")


@query(ORACLES["o16_new_sources"])
def o16_stored_sightings(spark, sf_dir):
    """Three updates of ten days each, the later days first."""
    path = shared(spark, "o16")
    for start, end in (("2024-01-11", "2024-01-21"), ("2024-01-21", None), (None, "2024-01-11")):
        sightings.update_sightings(prepare.filter_traffic(events(spark, sf_dir), start, end), path, "src")
    return sightings.sources_by_window(sightings.sightings(spark, path, "src"), "1 day")


@query(
    T
    + """select date_trunc('day', ts)::timestamp as win, src, count(*) filter (dst = 'signup') as num, count(*) filter (dst = 'purchase') as den,
 round(count(*) filter (dst = 'signup') / nullif(count(*) filter (dst = 'purchase'), 0)::double, 9) as ratio from traffic group by 1, 2"""
)
def o17_ratio_by_window(spark, sf_dir):
    return rounded(rates.ratio_by_window(events(spark, sf_dir), "src", "1 day", "dst = 'signup'", "dst = 'purchase'"), "ratio", digits=9)


@query(T + "select dst, dst_port, count(*) as packets, round(sum(bytes), 4) as bytes, grouping_id(dst, dst_port)::bigint as level from traffic group by rollup (dst, dst_port)")
def o18_rollup_traffic(spark, sf_dir):
    return rounded(rates.rollup_traffic(events(spark, sf_dir), ["dst", "dst_port"], bytes_col="bytes"), "bytes", digits=4)


@query(
    T
    + """, c as (select date_trunc('day', ts)::timestamp as win, dst_port, count(*) as n from traffic group by 1, 2), s as (select *, n / sum(n) over (partition by win)::double as p from c)
select win, sum(n)::bigint as packets, count(*) as n_values, round(-sum(p * log2(p)), 6) as entropy, round(coalesce(-sum(p * log2(p)) / nullif(log2(count(*)), 0), 0), 6) as normalised from s group by win"""
)
def o19_entropy_by_window(spark, sf_dir):
    return rounded(shape.entropy_by_window(events(spark, sf_dir), "dst_port", "1 day"), "entropy", "normalised")


@query(
    T
    + """, q as (select dst, count(*) / sum(count(*)) over ()::double as share from traffic group by dst), t as (select date_trunc('day', ts)::timestamp as win, count(*) as t from traffic group by 1),
 c as (select date_trunc('day', ts)::timestamp as win, dst, count(*) as n from traffic group by 1, 2)
select t.win, t.t as packets, round(sum((coalesce(n, 0) - share * t) ** 2 / (share * t)), 6) as chi2 from t cross join q left join c on c.win = t.win and c.dst = q.dst group by 1, 2"""
)
def o20_chi2_shift(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rounded(shape.chi2_shift(rows, "dst", "1 day", shape.baseline_mix(rows, "dst")), "chi2").drop("outside")


@query(
    T
    + """, q as (select dst, count(*) / sum(count(*)) over ()::double as share from traffic where dst in ('click', 'view') group by dst),
 c as (select time_bucket(interval '1 hour', ts, timestamp '1970-01-01')::timestamp as win, dst, count(*) as n from traffic group by 1, 2),
 w as (select win, sum(n) filter (dst in (select dst from q)) as t, sum(n) as total from c group by win)
select w.win, coalesce(t, 0)::bigint as packets, (total - coalesce(t, 0))::bigint as outside, round(coalesce(sum((coalesce(n, 0) - share * t) ** 2 / (share * t)), 0), 6) as chi2
 from w cross join q left join c on c.win = w.win and c.dst = q.dst group by w.win, t, total"""
)
def o20_chi2_outside(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rounded(shape.chi2_shift(rows, "dst", "1 hour", shape.baseline_mix(rows.where("dst in ('click', 'view')"), "dst")), "chi2")


GRID = T + ", grid as (select src, unnest(generate_series(min(win), max(win), interval '1 day')) as win from day group by src), dense as (select g.src, g.win::timestamp as win, coalesce(packets, 0) as packets from grid g left join day d on d.src = g.src and d.win = g.win)\n"


def daily(spark, sf_dir):
    return shape.dense_grid(rates.rate_by_window(events(spark, sf_dir), "src", "1 day"), "src", "1 day")


@query(GRID + "select src, win, packets from dense")
def o21_dense_grid(spark, sf_dir):
    return daily(spark, sf_dir)


@query(
    GRID
    + """, z as (select *, count(*) over w as n, avg(packets) over w as m, stddev_samp(packets) over w as s from dense window w as (partition by src order by win rows between 7 preceding and 1 preceding))
select src, win, packets, round(m, 6) as mean_prev, round(s, 6) as sd_prev, round((packets - m) / s, 6) as z from z where n = 7 and s > 0"""
)
def o22_zscore(spark, sf_dir):
    return rounded(shape.zscore(daily(spark, sf_dir), "src", 7), "mean_prev", "sd_prev", "z")


EWMA = (
    GRID.replace("with traffic", "with recursive traffic")
    + """, o as (select *, row_number() over (partition by src order by win) as i from dense),
 e(src, win, i, packets, ewma) as (select src, win, i, packets, packets::double from o where i = 1
  union all select o.src, o.win, o.i, o.packets, 0.3 * o.packets + 0.7 * e.ewma from e join o on o.src = e.src and o.i = e.i + 1)
select src, win, packets, round(ewma, 6) as ewma from e"""
)


@query(EWMA)
def o23_ewma(spark, sf_dir):
    return rounded(shape.ewma(daily(spark, sf_dir), "src", 0.3, 100), "ewma")


@query(EWMA)
def o23_ewma_blocks(spark, sf_dir):
    return rounded(shape.ewma_blocks(daily(spark, sf_dir), "src", 0.3, block="5 days"), "ewma")


CUSUM = GRID + """, p as (select *, sum(packets - 3.0::double) over (partition by src order by win) as p from dense),
 s as (select src, win, packets, p - least(0, min(p) over (partition by src order by win)) as cusum from p)
select src, win, packets, round(cusum, 6) as cusum, cusum >= 4 as alert from s"""


@query(CUSUM)
def o24_cusum(spark, sf_dir):
    return rounded(shape.cusum(daily(spark, sf_dir), "src", 3.0, 4.0), "cusum")


@query(CUSUM)
def o24_cusum_blocks(spark, sf_dir):
    return rounded(shape.cusum_blocks(daily(spark, sf_dir), "src", 3.0, 4.0, block="5 days"), "cusum")


def both_sides(rows):
    return rows.where("dst = 'signup'").select("src", "ts", "bytes", "record_id"), rows.where("dst = 'purchase'").select("src", "ts", "bytes", "record_id")


PAIRS = T + ", a as (select * from traffic where dst = 'signup'), b as (select * from traffic where dst = 'purchase'), pairs as (select a.src, a.record_id as req, b.record_id as resp, a.bytes as asked, b.bytes as sent from a join b on a.src = b.src and b.ts > a.ts and b.ts <= a.ts + interval '6 hours')\n"


@query(PAIRS + "select src, req as req_record_id, resp as resp_record_id from pairs")
def o25_match_responses(spark, sf_dir):
    return pairing.match_responses(*both_sides(events(spark, sf_dir)), "src", "6 hours").select("src", "req_record_id", "resp_record_id")


@query(PAIRS + "select src, req as req_record_id, resp as resp_record_id from pairs")
def o25_match_bucketed(spark, sf_dir):
    return pairing.match_responses(*both_sides(events(spark, sf_dir)), "src", "6 hours", bucket="6 hours").select("src", "req_record_id", "resp_record_id")


@query(PAIRS + "select src, record_id from a where record_id not in (select req from pairs)")
def o26_unanswered(spark, sf_dir):
    return pairing.unanswered(*both_sides(events(spark, sf_dir)), "src", "6 hours").select("src", "record_id")


@query(
    PAIRS
    + """select record_id, a.src, bytes as request_bytes, round(coalesce(sum(sent), 0), 6) as response_bytes, count(resp) as responses, round(coalesce(sum(sent), 0) / nullif(bytes, 0), 6) as factor
 from a left join pairs on req = record_id group by record_id, a.src, bytes"""
)
def o27_amplification_factor(spark, sf_dir):
    return rounded(pairing.amplification_factor(*both_sides(events(spark, sf_dir)), "src", "6 hours"), "response_bytes", "factor")


SESSIONS = T + """, f as (select *, case when ts <= lag(ts) over (partition by src order by ts) + interval '12 hours' then 0 else 1 end as new from traffic),
 n as (select *, sum(new) over (partition by src order by ts) as i from f),
 sess as (select src, min(ts) as start, max(ts) + interval '12 hours' as "end", count(*) as packets, round(sum(bytes), 6) as bytes from n group by src, i)
"""


@query(SESSIONS + "select * from sess")
def o28_sessionize(spark, sf_dir):
    return rounded(sessions.sessionize(events(spark, sf_dir), "src", "12 hours", bytes_col="bytes"), "bytes")


@query(
    T
    + """, g as (select *, date_diff('microsecond', lag(ts) over (partition by src order by ts, record_id), ts) / 1e6 as gap from traffic)
select src, count(*) as packets, round(sum(bytes), 4) as bytes, min(bytes) as min_bytes, max(bytes) as max_bytes, round(avg(bytes), 6) as mean_bytes, round(stddev_samp(bytes), 6) as sd_bytes,
 round(avg(gap), 4) as mean_gap, round(stddev_samp(gap), 4) as sd_gap, round(sum(gap), 4) as duration from g group by src"""
)
def o29_flow_features(spark, sf_dir):
    found = sessions.flow_features(events(spark, sf_dir), "src")
    return rounded(rounded(found, "mean_bytes", "sd_bytes"), "bytes", "mean_gap", "sd_gap", "duration", digits=4)


@query(
    T
    + """, a as (select *, case when win <= lag(win) over (partition by src order by win) + interval '1 day' then 0 else 1 end as new from day where packets >= 5),
 n as (select *, sum(new) over (partition by src order by win) as i from a)
select src, min(win) as start, max(win) as "end", max(packets) as peak, count(*) as n_windows from n group by src, i"""
)
def o30_incidents(spark, sf_dir):
    return sessions.incidents(rates.rate_threshold(events(spark, sf_dir), "src", "1 day", max_packets=5), "src", "1 day")


def two_detectors(spark, sf_dir):
    rows = events(spark, sf_dir)
    many = rates.rate_threshold(rows, "src", "1 day", max_packets=6).select("win", F.col("src").alias("key"), F.lit("rate").alias("rule"), F.lit(1.0).alias("weight"))
    share = rates.heavy_hitters(rows, "src", "1 day", 0.015).select("win", F.col("src").alias("key"), F.lit("share").alias("rule"), F.lit(0.5).alias("weight"))
    return many, share


@query(
    T
    + """, al as (select win, src as key, 'rate' as rule, 1.0::double as weight from day where packets >= 6
 union all select win, src, 'share', 0.5 from (select *, sum(packets) over (partition by win)::double as t from day) where packets / t >= 0.015)
select win, key, sum(weight) as score, count(*) as n_rules, string_agg(rule, ',' order by rule) as rules from al group by 1, 2"""
)
def o31_combine_alerts(spark, sf_dir):
    return sessions.combine_alerts(*two_detectors(spark, sf_dir))


@query(
    T
    + """, al as (select win, src from day where packets >= 6), tr as (select win, src from day where bytes >= 1500),
 c as (select count(*) filter (a.src is not null and t.src is not null) as tp, count(*) filter (t.src is null) as fp, count(*) filter (a.src is null) as fn
  from al a full join tr t on a.win = t.win and a.src = t.src)
select tp, fp, fn, round(tp / nullif(tp + fp, 0)::double, 9) as precision, round(tp / nullif(tp + fn, 0)::double, 9) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 9) as f1 from c"""
)
def o32_evaluate_alerts(spark, sf_dir):
    rows = events(spark, sf_dir)
    alerts = rates.rate_threshold(rows, "src", "1 day", max_packets=6)
    truth = rates.rate_threshold(rows, "src", "1 day", max_bytes=1500, bytes_col="bytes")
    return rounded(sessions.evaluate_alerts(alerts, truth, ["win", "src"]), "precision", "recall", "f1", digits=9)


# Streams end with a watermark of the last time less its delay; what is still open then has not been emitted.
@query(T + "select win, dst, packets from (select date_trunc('day', ts)::timestamp as win, dst, count(*) as packets from traffic group by 1, 2) where win + interval '1 day' <= (select max(ts) from traffic) - interval '1 hour'")
def o33_stream_rate(spark, sf_dir):
    found = drained(detect.stream_rate(stream(spark, sf_dir), "dst", "1 day", "1 hour"), "o33")
    return found.select(F.col("win").cast("timestamp_ntz").alias("win"), "dst", "packets")


@query(
    T
    + """, slid as (select unnest([time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - to_hours(6 * i) for i in range(4)]) as win, dst from traffic)
select win, dst, count(*) as packets from slid group by 1, 2 having win + interval '1 day' <= (select max(ts) from traffic) - interval '1 hour'"""
)
def o33_stream_sliding(spark, sf_dir):
    found = drained(detect.stream_rate(stream(spark, sf_dir), "dst", "1 day", "1 hour", slide="6 hours"), "o33s")
    return found.select(F.col("win").cast("timestamp_ntz").alias("win"), "dst", "packets")


@query(T + "select distinct record_id, src from traffic")
def o34_stream_dedup(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return drained(detect.stream_dedup(rows.unionByName(stream(spark, sf_dir)), "record_id", "60 days").select("record_id", "src"), "o34")


@query(SESSIONS + """select src, start, "end", packets from sess where "end" + interval '1 microsecond' <= (select max(ts) from traffic) - interval '1 hour'""")
def o35_stream_sessions(spark, sf_dir):
    found = drained(detect.stream_sessions(stream(spark, sf_dir), "src", "12 hours", "1 hour"), "o35")
    return found.select("src", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "packets")


@query(PAIRS + "select src, req as req_record_id, resp as resp_record_id from pairs")
def o36_stream_match(spark, sf_dir):
    req, resp = both_sides(stream(spark, sf_dir))[0], both_sides(stream(spark, sf_dir))[1]
    return drained(detect.stream_match(req, resp, "src", "6 hours", "1 hour").select("src", "req_record_id", "resp_record_id"), "o36")


@query(PAIRS + "select src, record_id from a where record_id not in (select req from pairs) and ts + interval '6 hours' < least((select max(ts) from a), (select max(ts) from b)) - interval '1 hour'")
def o37_stream_unanswered(spark, sf_dir):
    req, resp = both_sides(stream(spark, sf_dir))[0], both_sides(stream(spark, sf_dir))[1]
    return drained(detect.stream_unanswered(req, resp, "src", "6 hours", "1 hour").select("src", "record_id"), "o37")


@contextmanager
def rocksdb(spark):
    """Queries that start in this block keep their state in RocksDB, which operators with timers and several states need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query(PAIRS + "select src, record_id from a where record_id not in (select req from pairs) and ts + interval '6 hours' <= date_trunc('millisecond', least((select max(ts) from a), (select max(ts) from b))) - interval '1 hour'")
def o37_stream_unanswered_timed(spark, sf_dir):
    req, resp = both_sides(stream(spark, sf_dir))[0], both_sides(stream(spark, sf_dir))[1]
    with rocksdb(spark):
        return drained(detect.stream_unanswered_timed(req, resp, "src", "6 hours", "1 hour").select("src", "record_id"), "o37t")


@query(CUSUM)
def o38_stream_cusum(spark, sf_dir):
    path = shared(spark, "o38-rates")
    daily(spark, sf_dir).select("src", F.col("win").cast("timestamp").alias("win"), F.col("packets").cast("bigint").alias("packets")).write.parquet(path)
    with rocksdb(spark):
        rows = spark.readStream.schema("src bigint, win timestamp, packets bigint").parquet(path)
        found = drained(detect.stream_cusum(rows, "src", 3.0, 4.0), "o38")
    return rounded(found.withColumn("win", F.col("win").cast("timestamp_ntz")), "cusum")


@query(CUSUM + " where win <= (select max(win) from dense) - interval '11 days'")
def o38_stream_cusum_ordered(spark, sf_dir):
    """The rates come in five lots of files, of which each holds rows that are up to four days late; the watermark is 11 days behind.

    A lot spans at most 10 days, so no row is dropped should a batch take files of two lots."""
    path = shared(spark, "o38-late")
    late = F.datediff("win", F.lit("2024-01-01")) + F.pmod(F.hash("src"), F.lit(5))
    rows = daily(spark, sf_dir).select("src", F.col("win").cast("timestamp").alias("win"), F.col("packets").cast("bigint").alias("packets"), F.least(F.floor(late / 7), F.lit(4)).alias("file"))
    rows = rows.persist()
    parts = spark.sparkContext.defaultParallelism
    for i in range(5):
        rows.where(F.col("file") == i).drop("file").repartition(parts).write.mode("append").parquet(path)
    rows.unpersist()
    with rocksdb(spark):
        rates_ = spark.readStream.schema("src bigint, win timestamp, packets bigint").option("maxFilesPerTrigger", parts).parquet(path)
        found = drained(detect.stream_cusum_ordered(rates_, "src", 3.0, 4.0, "11 days"), "o38o")
    return rounded(found.withColumn("win", F.col("win").cast("timestamp_ntz")), "cusum")
