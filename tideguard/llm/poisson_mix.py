"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document gets a uniform number from a hash of its id and the seed, inverts the Poisson distribution whose mean
is its source's target repetition rate, and is repeated that many times; then all copies are shuffled globally, once: their
keys are uniform, so the range of keys that goes to a task is known beforehand and nothing is sampled or drawn twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import quoted, stored, table, without

#: Sources up to which the table of rates is broadcast (under 1 KB each); beyond it, it is joined with salted keys.
BROADCAST_SOURCES, SALTS = 4_096, 32
#: Sources weigh as their bytes to this power unless weights are given: smaller sources are raised.
EVENNESS = 0.5
#: A count of a larger mean is the sum of independent Poisson counts of equal means of at most this, which keeps exp(-mean) exact.
MOST = 32.0


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of key and seed: the middle of one of 2^32 equal steps."""
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 8)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def source_rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """source -> rate: how often each of its documents is repeated on average.

    With weight w and b bytes of B in all, a source's rate is epochs * B * w / b. Weights are relative; a source
    that weights does not name gets none. A source without any byte has rate 0.
    """
    totals = docs.groupBy(F.coalesce(quoted(source).cast("string"), F.lit("")).alias("__source")).agg(
        F.sum(F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("bigint")).alias("__bytes")
    )
    if weights is None:
        weight = F.pow(F.col("__bytes").cast("double"), F.lit(EVENNESS))
    elif weights:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(named[F.col("__source")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    totals = stored(totals.withColumn("__weight", weight), "sources")
    whole, weighed = totals.agg(F.sum("__bytes"), F.sum("__weight")).first()
    share = F.try_divide(F.col("__weight") * F.lit(whole or 0), F.lit(weighed or 0.0) * F.col("__bytes"))
    return totals.select("__source", (F.coalesce(share, F.lit(0.0)) * F.lit(float(epochs))).alias("__rate"))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative Poisson probability exceeds u. Terms are summed until they are under 1e-15."""
    steps = F.sequence(F.lit(1), F.ceil(mean + F.lit(12) * F.sqrt(mean) + F.lit(16)).cast("int"))
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * mean / i
        return F.when(acc["sum"] > u, acc).otherwise(F.struct(i.alias("k"), term.alias("term"), (acc["sum"] + term).alias("sum")))

    return F.aggregate(steps, start, step, lambda acc: acc["k"])


def count(key: Column, rate: Column, seed: int) -> Column:
    """A Poisson count of any rate for a key: the sum of as many independent ones as keep each mean at most MOST."""
    parts = F.greatest(F.ceil(rate / F.lit(MOST)), F.lit(1)).cast("int")
    mean = rate / parts

    def add(total: Column, part: Column) -> Column:
        return total + poisson(uniform(F.when(part == 0, key).otherwise(F.concat_ws(":", key, part)), seed), mean)

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), add)


def mix_sources(
    docs: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = 42,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Repeat each row a Poisson number of times, so that sources come to their weights in expectation, and shuffle.

    Adds rate (the mean), copies (the count), copy (from 1) and shuffle_key, by which the result is ordered. Rows
    with count 0 go: that is the draw. Null sources are one source, the empty name; a null text has no bytes; rows with
    equal ids draw equal counts and each row is repeated by itself. A row without an id draws by its text and its row number in
    docs, so such rows draw independently; docs should be a table, whose row numbers are settled. An empty table gives
    an empty one. Columns named as an output are replaced; others may have any name. A mean above MOST is drawn in independent parts.
    """
    made = ["rate", "copies", "copy", "shuffle_key"]
    keep = [c for c in (docs.columns if keep is None else keep) if c in set(without(docs, made))]
    rates = source_rates(docs, source, text, weights, epochs)
    unnamed = F.concat_ws(":", F.lit("row"), F.monotonically_increasing_id(), F.xxhash64(quoted(text)))
    key = F.coalesce(quoted(id_col).cast("string"), unnamed)
    held = [f"c{i}" for i in range(len(keep))]  # so that no name can clash
    rows = docs.select(*[quoted(c).alias(h) for c, h in zip(keep, held)], key.alias("__id"), F.coalesce(quoted(source).cast("string"), F.lit("")).alias("__source"))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        rows = rows.join(F.broadcast(rates), "__source")
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")).join(salted, ["__source", "__salt"])
    rows = rows.withColumn("copies", count(F.col("__id"), F.col("__rate"), seed)).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), F.col("__id"), F.col("copy")))
    rows = rows.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], F.col("__rate").alias("rate"), "copies", "copy", order.alias("shuffle_key"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # task i gets the i-th of equal ranges of the keys' first 32 bits
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint") * tasks / F.lit(1 << 32)).cast("int")
    return rows.repartitionById(tasks, part).sortWithinPartitions("shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy", "shuffle_key")


ORACLE_SQL = """
with recursive
 totals as (select coalesce(source, '') as s, sum(coalesce(strlen(text), 0))::double as b from documents group by 1),
 whole as (select sum(b) as b, sum(sqrt(b)) as w from totals),
 rates as (select s, coalesce(sqrt(t.b) * w.b / nullif(w.w * t.b, 0), 0) as rate from totals t, whole w),
 split as (select s, rate, greatest(ceil(rate / 32), 1)::int as parts, rate / greatest(ceil(rate / 32), 1)::int as mean from rates),
 cdf(s, mean, k, term, total) as (
  select s, mean, 0, exp(-mean), exp(-mean) from split
  union all
  select s, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) from cdf where k < ceil(mean + 12 * sqrt(mean) + 16)),
 steps as (select s, array_agg(total order by k) as totals from cdf group by s),
 drawn as (
  select d.doc_id, d.source, r.rate,
   list_sum(list_transform(range(r.parts), lambda p: least(len(list_filter(t.totals,
    lambda x: x <= (('0x' || substr(md5('42:' || d.doc_id || case when p = 0 then '' else ':' || p end), 1, 8))::bigint + 0.5) / 4294967296)), len(t.totals) - 1)))::int as copies
  from documents d join split r on r.s = coalesce(d.source, '') join steps t on t.s = r.s)
select doc_id, source, round(rate, 6) as rate, copies::int as copies, copy::int as copy,
 md5('order-42:' || doc_id || ':' || copy) as shuffle_key
from (select *, unnest(range(1, copies + 1)) as copy from drawn where copies > 0)
"""
