"""Detectors on streams. Each emits a result once, in append mode, when the watermark has closed it.

A row older than the watermark still counts while its window is open, and is dropped afterwards.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType

from tideguard.functions.columns import listed, quoted, weight
from tideguard.functions.time import interval, micros, seconds, window_start
from tideguard.operators.pairing import prefixed


def stream_rate(
    df: DataFrame, keys: str | Sequence[str], size: str, watermark: str, slide: str | None = None, time_col: str = "ts", packets: str | None = None, bytes_col: str | None = None, max_packets: float | None = None
) -> DataFrame:
    """O33. rate_by_window, or with max_packets rate_threshold, on a stream: each window once, when it is closed."""
    window = F.window(F.col(time_col), size, slide).alias("w")
    total = F.sum(F.col(bytes_col) if bytes_col else F.lit(0))
    rates = df.withWatermark(time_col, watermark).groupBy(window, *listed(keys)).agg(F.sum(weight(packets)).alias("packets"), total.alias("bytes"))
    span = float(seconds(size))
    rates = rates.select(F.col("w.start").alias("win"), *listed(keys), "packets", "bytes", (F.col("packets") / span).alias("packet_rate"), (F.col("bytes") / span).alias("byte_rate"))
    return rates if max_packets is None else rates.where(F.col("packets") >= max_packets)


def stream_dedup(df: DataFrame, id_cols: str | Sequence[str], watermark: str, time_col: str = "ts") -> DataFrame:
    """O34. dedup_records on a stream: an id is known for as long as the watermark lags, so state is bounded."""
    return df.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(listed(id_cols))


def stream_sessions(df: DataFrame, keys: str | Sequence[str], gap: str, watermark: str, time_col: str = "ts", bytes_col: str | None = None) -> DataFrame:
    """O35. sessionize on a stream."""
    window = F.session_window(F.col(time_col), F.lit(f"{micros(gap) + 1} microseconds")).alias("w")
    total = F.sum(F.col(bytes_col) if bytes_col else F.lit(0))
    found = df.withWatermark(time_col, watermark).groupBy(window, *listed(keys)).agg(F.count("*").alias("packets"), total.alias("bytes"))
    end = F.col("w.end") - F.expr("interval '0.000001' second")
    return found.select(*listed(keys), F.col("w.start").alias("start"), end.alias("end"), "packets", "bytes")


def _joined(req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, watermark: str, time_col: str, how: str) -> DataFrame:
    on = listed(on)
    a = prefixed(req, on, "req_").withWatermark(f"req_{time_col}", watermark).alias("a")
    b = prefixed(resp, on, "resp_").withWatermark(f"resp_{time_col}", watermark).alias("b")
    r, s = F.col(f"req_{time_col}"), F.col(f"resp_{time_col}")
    condition = (s > r) & (s <= r + F.expr(interval(within)))
    for k in on:
        condition = condition & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    rest = [c for c in (*a.columns, *b.columns) if c not in on]
    return a.join(b, condition, how).select(*[F.col(f"a.{k}").alias(k) for k in on], *rest)


def stream_match(req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, watermark: str, time_col: str = "ts") -> DataFrame:
    """O36. match_responses on two streams; both sides' state is bounded by the interval and the watermark."""
    return _joined(req, resp, on, within, watermark, time_col, "inner")


def stream_unanswered(req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, watermark: str, time_col: str = "ts") -> DataFrame:
    """O37. unanswered on two streams, as Spark has no streaming anti join: an outer join's rows without a response.

    A request is held until its interval has passed the watermark; at the end of a finite input the last ones stay.
    """
    joined = _joined(req, resp, on, within, watermark, time_col, "left_outer")
    on = listed(on)
    rows = joined.where(F.col(f"resp_{time_col}").isNull())
    return rows.select(*[F.col(c if c in on else f"req_{c}").alias(c) for c in req.columns])


#: Requests or responses that one entry of state holds at most.
ENTRY = 10_000


def frozen(value):
    """A value as a dictionary's key, equal where Spark's grouping has it equal: NaN is itself, nested and binary values can be hashed."""
    if isinstance(value, (tuple, list)):
        return tuple(map(frozen, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return value if value == value else "NaN"


def dealt(keys: Sequence[Column], groups: int) -> Column:
    """The number of a row's group of keys. One group's state is a few entries of many rows, as each access to state from Python is a message."""
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("g")


class UnansweredProcessor(StatefulProcessor):
    """Holds a group's open requests until a response or their timer, and its responses until the watermark has passed them, as a
    request that comes later may still be older than they are. Times are microseconds.

    An entry of state is what one batch brought for the group, in the order of time and named by its first time. Rows begin with n_keys
    columns, of which the first are the group's and the others a key within it.
    """

    def __init__(self, within: int, n_keys: int, columns: list[str]):
        self.within, self.n_keys, self.row = within, n_keys, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at bigint, n bigint", "requests binary")
        self.answers = handle.getMapState("answers", "at bigint", "last bigint, times binary")
        self.passed = set()

    def answered(self, at: int, times: list[int]) -> bool:
        first = bisect_right(times, at)
        return first < len(times) and times[first] <= at + self.within

    def unanswered(self, requests: list[tuple], times: dict[tuple, list[int]]) -> list[tuple]:
        return [q for q in requests if not self.answered(q[0], times.get(frozen(q[1]), ()))]

    def hold(self, requests: list[tuple], n: int) -> int:
        """Keep requests in entries numbered from n, each with a timer for its first; returns the next number."""
        for i in range(0, len(requests), ENTRY):
            part = requests[i : i + ENTRY]
            self.open.updateValue((part[0][0], n), (pickle.dumps(part),))
            self.handle.registerTimer(-(-(part[0][0] + self.within) // 1000))
            n += 1
        return n

    def hold_answers(self, found: list[tuple]) -> None:
        """Keep responses; an entry goes when the watermark has passed its last."""
        for i in range(0, len(found), ENTRY):
            part = found[i : i + ENTRY]
            first = (part[0][0],)
            if self.answers.containsKey(first):
                part = sorted(part + pickle.loads(bytes(self.answers.getValue(first)[1])), key=itemgetter(0))
            self.answers.updateValue(first, (part[-1][0], pickle.dumps(part)))
            self.handle.registerTimer(-(-part[-1][0] // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked, new, n = [], set(), self.n_keys
        for r in rows:
            own, at = r[len(key) : n], r[n + 1]
            if r[n + 2]:
                asked.append((at, own, r[n + 3 :]))
            elif None not in key and None not in own:
                new.add((at, frozen(own)))
        new = sorted(new, key=itemgetter(0))
        if new:
            times = by_key(new)
            for entry, (held,) in [(tuple(k), tuple(v)) for k, v in self.open.iterator()]:
                before = pickle.loads(bytes(held))
                left = self.unanswered(before, times)
                if not left:
                    self.open.removeKey(entry)
                elif len(left) < len(before):
                    self.open.updateValue(entry, (pickle.dumps(left),))
            self.hold_answers(new)
        if asked:
            known = [pair for _, v in self.answers.iterator() for pair in pickle.loads(bytes(v[1]))]
            left = self.unanswered(asked, by_key(sorted(known, key=itemgetter(0))))
            if left:
                self.hold(sorted(left, key=itemgetter(0)), max((k[1] for k in self.open.keys()), default=0) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if (key, now) in self.passed:  # of timers that expire together the first does all the work
            return
        self.passed.add((key, now))
        entries = sorted((tuple(k), tuple(v)) for k, v in self.open.iterator())
        n = max((k[1] for k, _ in entries), default=0) + 1
        for entry, (held,) in entries:
            if entry[0] + self.within > now:
                break
            requests = pickle.loads(bytes(held))
            self.open.removeKey(entry)
            n = self.hold([q for q in requests if q[0] + self.within > now], n)
            for at, own, request in requests:
                if at + self.within <= now:
                    yield self.row(*key, *own, *request)
        for entry in [tuple(k) for k, v in self.answers.iterator() if v[0] <= now]:
            self.answers.removeKey(entry)

    def close(self) -> None:
        pass


def by_key(pairs: list[tuple]) -> dict[tuple, list[int]]:
    """Each key's times, in their order among (time, key)."""
    found = defaultdict(list)
    for at, own in pairs:
        found[own].append(at)
    return found


def stream_unanswered_timed(req: DataFrame, resp: DataFrame, on: str | Sequence[str], within: str, watermark: str, time_col: str = "ts", groups: int = 256) -> DataFrame:
    """O37 with timers: a request is emitted in the first batch whose watermark has reached its time + within, and never before.

    Requests and responses are one keyed state. A response may come before or after its request, in any batch, as long as neither
    is older than the watermark. State is a request for as long as it is open, and a response's time until the watermark has
    passed it and those that came with it. A request without a key is never answered; rows without a time are left out. Needs the
    RocksDB state store.

    A state is a group of keys in a time bucket as long as the interval: a response goes to its bucket and the one before, so a hot key
    is the work of many tasks and a batch touches only buckets that it has rows for. With more rows in a bucket take more groups, in a new checkpoint.
    """
    keys = listed(on)
    rest = [c for c in req.columns if c not in keys]
    zoned = {f.name for f in req.schema.fields if isinstance(f.dataType, TimestampType)}
    by = [f"k{i}" for i in range(len(keys))]
    size = max(micros(within), 1)
    start = F.col("at") - F.pmod("at", F.lit(size))

    def side(df: DataFrame, ask: bool) -> DataFrame:
        time = quoted(time_col).cast("timestamp")
        own = [(F.unix_micros(quoted(c)) if c in zoned else quoted(c)) if ask else F.lit(None) for c in rest]
        kinds = ["bigint" if c in zoned else req.schema[c].dataType for c in rest]
        held = [x.cast(kind).alias(f"r{i}") for i, (x, kind) in enumerate(zip(own, kinds))]
        plain = df.select(*[quoted(k).alias(b) for k, b in zip(keys, by)], time.alias("time"), F.unix_micros(time).alias("at"), F.lit(ask).alias("ask"), *held)
        plain = plain.where("time is not null").withWatermark("time", watermark)
        buckets = F.array(start) if ask else F.array(start, start - size)
        return plain.select(dealt([F.col(b) for b in by], groups), F.explode(buckets).alias("bucket"), *plain.columns)

    both = side(req, True).unionByName(side(resp, False))
    schema = StructType([f for f in both.schema.fields if f.name not in ("time", "at", "ask")])
    found = both.groupBy("g", "bucket").transformWithState(UnansweredProcessor(micros(within), 2 + len(keys), schema.names), schema, "append", "eventTime")
    back = {k: F.col(b) for k, b in zip(keys, by)}
    back |= {c: F.timestamp_micros(f"r{i}") if c in zoned else F.col(f"r{i}") for i, c in enumerate(rest)}
    return found.select(*[back[c].alias(c) for c in req.columns])


class CusumProcessor(StatefulProcessor):
    """Holds each key's sum across batches."""

    def __init__(self, keys: list[str], drift: float, limit: float, value: str):
        self.keys, self.drift, self.limit, self.value = keys, drift, limit, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sum = handle.getValueState("sum", "s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("win", kind="stable")
        held = self.sum.get()[0] if self.sum.exists() else 0.0
        sums = []
        for x in got[self.value]:
            held = max(0.0, held + float(x) - self.drift)
            sums.append(held)
        self.sum.update((held,))
        out = got[[*self.keys, "win", self.value]].assign(cusum=sums)
        yield out.assign(alert=out["cusum"] >= self.limit)

    def close(self) -> None:
        pass


class OrderedCusumProcessor(StatefulProcessor):
    """Holds a group's rows until the watermark has passed them, and the sums of its keys up to there. Times are microseconds.

    An entry of state is a window's rows. Rows begin with the group and the key within it, and end with at and value.
    """

    def __init__(self, drift: float, limit: float, columns: list[str]):
        self.drift, self.limit, self.row, self.n_keys = drift, limit, Row(*columns), len(columns) - 4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "rows binary")
        self.sums = handle.getValueState("sums", "sums binary")
        self.passed = set()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = defaultdict(list)
        for r in rows:
            new[r[-2]].append((r[1 : self.n_keys], r[-1]))
        for at, got in new.items():
            held = pickle.loads(bytes(self.waiting.getValue((at,))[0])) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (pickle.dumps(held + got),))
            self.handle.registerTimer(-(-at // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if (key, now) in self.passed:  # of timers that expire together the first does all the work
            return
        self.passed.add((key, now))
        ready = sorted(k[0] for k in self.waiting.keys() if k[0] <= now)
        if not ready:
            return
        sums = pickle.loads(bytes(self.sums.get()[0])) if self.sums.exists() else {}
        for at in ready:
            for own, x in sorted(pickle.loads(bytes(self.waiting.getValue((at,))[0])), key=lambda v: (v[1] is None, v[1])):
                name = frozen(own)
                held = max(0.0, sums.pop(name, 0.0) + (0.0 if x is None else float(x) - self.drift))
                if held != 0.0:
                    sums[name] = held
                yield self.row(*key, *own, at, x, held, held >= self.limit)
            self.waiting.removeKey((at,))
        self.sums.update((pickle.dumps(sums),))

    def close(self) -> None:
        pass


def stream_cusum_ordered(df: DataFrame, keys: str | Sequence[str], drift: float, limit: float, watermark: str, value: str = "packets", groups: int = 256) -> DataFrame:
    """O38 with late rows in order: cusum on a stream of window rates (key, win, value), whatever order they come in.

    A row waits until the watermark has passed its window and is then added in the order of windows, so a late row in a later
    batch gives what cusum gives on all rows; a row older than the watermark is dropped. State is the waiting rows and
    one sum a key, those of a group of keys together. Equal windows of a key are added by ascending value; a null value leaves the
    sum as it is; rows without a window are left out. With more keys take more groups, in a new checkpoint. Needs the RocksDB state store.
    """
    keys = listed(keys)
    by = [f"k{i}" for i in range(len(keys))]
    plain = df.where(quoted("win").isNotNull()).select(
        *[quoted(k).alias(b) for k, b in zip(keys, by)], quoted("win").cast("timestamp").alias("time"), F.unix_micros(quoted("win").cast("timestamp")).alias("at"), quoted(value).alias("value")
    )
    plain = plain.withWatermark("time", watermark)
    plain = plain.select(dealt([F.col(b) for b in by], groups), *plain.columns)
    schema = StructType([f for f in plain.schema.fields if f.name != "time"]).add("cusum", "double").add("alert", "boolean")
    found = plain.groupBy("g").transformWithState(OrderedCusumProcessor(float(drift), float(limit), schema.names), schema, "append", "eventTime")
    return found.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.timestamp_micros("at").alias("win"), F.col("value").alias(value), "cusum", "alert")


def stream_cusum(df: DataFrame, keys: str | Sequence[str], drift: float, limit: float, value: str = "packets") -> DataFrame:
    """O38. cusum on a stream of window rates (key, win, value), with one number of state a key.

    Rows are in time order within a batch; a late row in a later batch is applied when it arrives. Needs the RocksDB
    state store.
    """
    keys = listed(keys)
    fields = [f for f in df.schema.fields if f.name in (*keys, "win", value)]
    order = [*keys, "win", value]
    fields.sort(key=lambda f: order.index(f.name))
    schema = StructType(fields).add("cusum", "double").add("alert", "boolean")
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=CusumProcessor(keys, float(drift), float(limit), value), outputStructType=schema, outputMode="append", timeMode="none"
    )
