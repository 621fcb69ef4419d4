"""Selecting and matching records before detection."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tideguard.functions import bloom
from tideguard.functions.columns import listed, quoted, spare


def filter_traffic(df: DataFrame, start: str | None = None, end: str | None = None, predicate: str | None = None, time_col: str = "ts") -> DataFrame:
    """O4. Records with start <= time < end that satisfy a SQL predicate; all three reach the scan."""
    kind = dict(df.dtypes)[time_col]
    for bound, op in ((start, ">="), (end, "<")):
        if bound is not None:
            df = df.where(F.expr(f"`{time_col}` {op} cast('{bound}' as {kind})"))
    return df if predicate is None else df.where(predicate)


def dedup_records(df: DataFrame, id_cols: str | Sequence[str]) -> DataFrame:
    """O5. One record of each that was exported several times under one id. Which of them stays is arbitrary."""
    return df.dropDuplicates(listed(id_cols))


def match_list(df: DataFrame, entries: DataFrame, on: str | Sequence[str], keep: str = "listed") -> DataFrame:
    """O6. Records whose key is in a list ('listed') or isn't ('unlisted'). A null key, on either side, is unlisted."""
    if keep not in ("listed", "unlisted"):
        raise ValueError(keep)
    return df.join(entries.select(*listed(on)).distinct(), listed(on), "left_semi" if keep == "listed" else "left_anti")


def match_large_list(df: DataFrame, entries: DataFrame, on: str | Sequence[str], keep: str = "listed") -> DataFrame:
    """O6 for lists too long to broadcast: match_list, with a Bloom filter of the entries before the shuffle.

    Records that the filter lacks are unlisted where they are read; only the others, which are the listed ones and about one in
    1,000 of the rest for up to 4 million entries, are shuffled to meet the list. A null key, on either side, is unlisted.
    """
    if keep not in ("listed", "unlisted"):
        raise ValueError(keep)
    keys = listed(on)
    # both sides' keys in the type in which they are compared, as hashes depend on it
    kinds = df.select(*[quoted(k) for k in keys]).limit(0).union(entries.select(*[quoted(k) for k in keys]).limit(0)).schema
    by = [spare(f"__k{i}", df.columns) for i in range(len(keys))]
    some = F.lit(True)
    for b in by:
        some = some & F.col(b).isNotNull()
    wanted = entries.select(*[quoted(k).cast(f.dataType).alias(b) for k, f, b in zip(keys, kinds, by)]).where(some).distinct()
    blocks = bloom.blocks_for(wanted.count())
    rows = df.withColumns({b: quoted(k).cast(f.dataType) for k, f, b in zip(keys, kinds, by)})
    passes = spare("__passes", rows.columns)
    rows = bloom.tested(rows, by, bloom.bloom_filter(wanted, by, blocks), blocks, passes)
    possible = rows.where(F.col(passes) & some)
    if keep == "listed":
        return possible.join(wanted, by, "left_semi").select(*[quoted(c) for c in df.columns])
    return rows.where(~(F.col(passes) & some)).unionByName(possible.join(wanted, by, "left_anti")).select(*[quoted(c) for c in df.columns])


#: Different prefixes up to which the table of bins is broadcast, and the most rules that one bin lists.
BROADCAST_RULES, MOST_IN_BIN = 50_000, 32


def address_digits(column: Column, kind: str) -> Column:
    """4 or 6 for the family, then the address in hexadecimal digits, so that order is that of addresses. A number is IPv4, binary is 4 or
    16 bytes; null for anything else."""
    if kind == "binary":
        size = F.octet_length(column)
        return F.when(size == 4, F.concat(F.lit("4"), F.hex(column))).when(size == 16, F.concat(F.lit("6"), F.hex(column)))
    number = column.cast("bigint")
    return F.when(number.between(0, (1 << 32) - 1), F.concat(F.lit("4"), F.lpad(F.hex(number), 8, "0")))


def prefix_ranges(rules: DataFrame) -> DataFrame:
    """plen, lo and hi (first and last address, as address_digits) and rule_id, one row a prefix, that of the lowest id."""
    if dict(rules.dtypes)["pfx"] == "binary":
        digits = address_digits(F.col("pfx"), "binary")
    else:  # the leading plen bits
        known = F.col("plen").between(0, 32) & F.col("pfx").between(0, F.expr("shiftleft(1L, cast(plen as int)) - 1"))
        digits = F.when(known, address_digits(F.expr("shiftleft(cast(pfx as bigint), 32 - cast(plen as int))"), "bigint"))
    named = rules.select("rule_id", F.col("plen").cast("int").alias("plen"), digits.alias("digits"))
    named = named.where("digits is not null and plen between 0 and 4 * (length(digits) - 1)")
    whole, rest = "1 + plen div 4", "plen % 4"
    digit = f"cast(conv(substring(digits, {whole} + 1, 1), 16, 10) as int)"
    free = f"cast(shiftleft(1, 4 - cast({rest} as int)) - 1 as int)"

    def ended(mixed: str, fill: str) -> str:
        return f"rpad(concat(substring(digits, 1, cast({whole} as int)), if({rest} = 0, '', hex({mixed}))), length(digits), '{fill}')"

    ranges = named.select("rule_id", "plen", F.expr(ended(f"{digit} & ~{free}", "0")).alias("lo"), F.expr(ended(f"{digit} | {free}", "F")).alias("hi"))
    return ranges.groupBy("plen", "lo", "hi").agg(F.min("rule_id").alias("rule_id"))


def prefix_bins(ranges: DataFrame) -> DataFrame:
    """The rules as bins of a tree: key (a family and whole bytes of an address), whole (the longest rule that covers all of the bin, but
    not its parent), and listed (the rules inside the bin, longest first, unless the bin is split).

    A bin with more than MOST_IN_BIN rules inside is split by the next byte, so a bin lists few rules however many there are and
    however they overlap. A rule is listed once and covers 128 bins at most.
    """
    rule = F.struct("plen", "rule_id", "lo", "hi").alias("rule")
    at = ranges.select("lo", "plen", rule)
    inside = at.where("plen > 0").select("rule", F.explode(F.expr("transform(sequence(0, (plen - 1) div 8), j -> substring(lo, 1, cast(1 + 2 * j as int)))")).alias("key"))
    split = inside.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_BIN).select("key")
    parents = split.withColumnRenamed("key", "parent")

    def below_split(df: DataFrame) -> DataFrame:
        df = df.withColumn("parent", F.expr("if(length(key) > 1, substring(key, 1, length(key) - 2), null)"))
        return df.where("parent is null").drop("parent").unionByName(df.join(parents, "parent", "left_semi").drop("parent"))

    lists = below_split(inside.join(split, "key", "left_anti")).groupBy("key").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("listed"))
    # from lo's last byte, 2 ^ (bits that the last byte leaves free) bins
    size = "cast(1 + 2 * ((plen + 7) div 8) as int)"
    byte = f"cast(conv(substring(lo, {size} - 1, 2), 16, 10) as int)"
    bins = f"transform(sequence({byte}, {byte} + shiftleft(1, cast((8 - plen % 8) % 8 as int)) - 1), b -> concat(substring(lo, 1, {size} - 2), lpad(hex(b), 2, '0')))"
    keys = at.select("rule", F.explode(F.expr(f"if(plen = 0, array(substring(lo, 1, 1)), {bins})")).alias("key"))
    whole = below_split(keys).groupBy("key").agg(F.max("rule").alias("whole"))
    return whole.join(lists, "key", "full")


def few_bins(ranges: DataFrame, rows: Sequence[Row]) -> tuple[DataFrame, int]:
    """prefix_bins of at most BROADCAST_RULES rules, which are rows, and its longest key, made on the driver, as all tasks get
    the table anyway."""
    inside, whole = defaultdict(list), {}
    rules = [(r.plen, r.rule_id, r.lo, r.hi) for r in rows]
    for rule in rules:
        for j in range((rule[0] + 7) // 8):
            inside[rule[2][: 1 + 2 * j]].append(rule)
    split = {key for key, held in inside.items() if len(held) > MOST_IN_BIN}

    def reached(key: str) -> bool:
        return len(key) == 1 or key[:-2] in split

    for rule in sorted(rules, key=lambda r: r[0]):  # longer ones come later and stay
        plen, _, lo, _ = rule
        n = (plen + 7) // 8
        if reached(lo[: 1 + 2 * n]):
            first = int(lo[2 * n - 1 : 2 * n + 1], 16) if n else 0
            keys = [f"{lo[: 2 * n - 1]}{b:02X}" for b in range(first, first + (1 << 8 * n - plen))] if n else [lo[0]]
            whole |= dict.fromkeys(keys, rule)
    lists = {key: sorted(held, key=lambda r: -r[0]) for key, held in inside.items() if key not in split and reached(key)}
    kind = ranges.select(F.struct("plen", "rule_id", "lo", "hi").alias("rule")).schema["rule"].dataType
    schema = StructType([StructField("key", StringType()), StructField("whole", kind), StructField("listed", ArrayType(kind))])
    keys = whole.keys() | lists.keys()
    return ranges.sparkSession.createDataFrame([(key, whole.get(key), lists.get(key)) for key in keys], schema), max(map(len, keys), default=1)


def cidr_match(df: DataFrame, rules: DataFrame, ip_col: str = "src_ip", id_cols: str | Sequence[str] | None = None) -> DataFrame:
    """O7. Each record's rule of the longest matching prefix; ties go to the lowest rule_id. Adds rule_id and plen.

    Addresses are numbers (IPv4) or binary (4 or 16 bytes, IPv4 or IPv6, mixed as they come). rules: rule_id, pfx and plen; pfx is the
    prefix's leading plen bits as a number (IPv4), or a binary address of 4 or 16 bytes, whose further bits don't matter. Any
    number of rules, nested or repeated, becomes one table of bins, each of which lists few (prefix_bins); a record meets one
    bin for each byte by which some bin is split, by equi-joins that never repeat it, so id_cols are not needed and not looked at. The
    two upper levels, 514 bins, are always broadcast; the others up to BROADCAST_RULES prefixes, which are counted first.
    Records without a match or an address, and rules without a valid prefix, are left out. Columns may have any name; those
    named rule_id and plen are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in ("rule_id", "plen")]
    held = [f"c{i}" for i in range(len(kept))]
    ranges = prefix_ranges(rules)
    some = ranges.limit(BROADCAST_RULES + 1).collect()
    if few := len(some) <= BROADCAST_RULES:
        bins, deepest = few_bins(ranges, some)
    else:
        bins = prefix_bins(ranges)
        deepest = bins.agg(F.max(F.length("key"))).first()[0]
    found = df.select(*[quoted(c).alias(h) for c, h in zip(kept, held)], address_digits(quoted(ip_col), dict(df.dtypes)[ip_col]).alias("address")).where("address is not null")
    best = []
    for n, size in enumerate(range(1, deepest + 1, 2)):
        level = bins.where(F.length("key") == size).select(F.col("key").alias(f"key{n}"), F.col("whole").alias(f"whole{n}"), F.col("listed").alias(f"listed{n}"))
        level = F.broadcast(level) if few or n < 2 else level
        found = found.join(level, F.expr(f"substring(address, 1, {size})") == F.col(f"key{n}"), "left")
        fits = F.filter(f"listed{n}", lambda r: (F.col("address") >= r["lo"]) & (F.col("address") <= r["hi"]))
        hit = F.coalesce(F.get(fits, F.lit(0)), F.col(f"whole{n}")).alias(f"hit{n}")
        found = found.select(*held, "address", *[f"hit{i}" for i in range(n)], hit)
        best.insert(0, f"hit{n}")
    found = found.withColumn("rule", F.coalesce(*best)).where("rule is not null")
    return found.select(*[F.col(h).alias(c) for c, h in zip(kept, held)], F.col("rule.rule_id").alias("rule_id"), F.col("rule.plen").alias("plen"))
