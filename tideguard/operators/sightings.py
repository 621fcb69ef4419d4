"""First sightings that are kept from one run to the next, so that a run reads new traffic alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.functions import bloom
from tideguard.functions.columns import listed, quoted
from tideguard.functions.time import window_start
from tideguard.sources.traffic import remove_folder, sub_folders

#: Blocks of the filter of known sources, 2 MB: one in 1,000 new sources passes falsely at a million known ones.
BLOCKS = 1 << 16


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that updates have added; a source has several if it was later seen to have come earlier."""
    return spark.read.parquet(f"{path}/seen").drop("__batch") if sub_folders(spark, f"{path}/seen") else None


def update_sightings(new: DataFrame, path: str, src: str | Sequence[str], time_col: str = "ts", blocks: int = BLOCKS) -> DataFrame:
    """O16. Add new traffic to the table of first sightings at path, and give what it changed: src and first_ts of sources that are
    new, or earlier than known.

    New records are summed to one row a source. Those that the stored Bloom filter of known sources lacks are new and meet no
    other table; the others are joined with the stored sightings. Old traffic is not read. Traffic may come in any order and
    repeatedly; a run that failed between its two writes leaves a filter that lacks sources, which may then be added again,
    and sightings() takes the earliest. A null source is a source; records without a time are left out. One update runs at a
    time, always with the same number of blocks.
    """
    spark, keys = new.sparkSession, listed(src)
    batch = new.where(quoted(time_col).isNotNull()).groupBy(*[quoted(k) for k in keys]).agg(F.min(time_col).alias("first_ts"))
    known = stored(spark, path)
    versions = sorted(int(f.partition("=")[2]) for f in sub_folders(spark, f"{path}/filter"))
    old = spark.read.parquet(f"{path}/filter/__version={versions[-1]}") if versions else None
    if known is not None and old is not None:
        marked = bloom.tested(batch, keys, old, blocks, "__known")
        # structs are never null, so a null source meets itself
        key = F.struct(*[quoted(k) for k in keys])
        least = known.groupBy(*[quoted(k) for k in keys]).agg(F.min("first_ts").alias("__least")).select(key.alias("__key"), "__least")
        possible = marked.where("__known").withColumn("__key", key).join(least, "__key", "left").where("__least is null or first_ts < __least")
        batch = marked.where("not __known").drop("__known").unionByName(possible.drop("__known", "__key", "__least"))
    n = len(sub_folders(spark, f"{path}/seen"))
    batch.write.parquet(f"{path}/seen/__batch={n}")
    added = spark.read.schema(batch.schema).parquet(f"{path}/seen/__batch={n}")
    bits = bloom.bloom_filter(added, keys, blocks)
    (bits if old is None else bloom.merged(old, bits)).write.parquet(f"{path}/filter/__version={n}")
    for version in versions[:-1]:  # the one before stays for who reads it now
        remove_folder(spark, f"{path}/filter/__version={version}")
    return added


def sightings(spark: SparkSession, path: str, src: str | Sequence[str]) -> DataFrame:
    """O16. src and first_ts of all sources that updates have seen."""
    return stored(spark, path).groupBy(*[quoted(k) for k in listed(src)]).agg(F.min("first_ts").alias("first_ts"))


def sources_by_window(seen: DataFrame, size: str) -> DataFrame:
    """O16. new_sources from sightings: how many sources are first seen in each window."""
    return seen.groupBy(window_start("first_ts", size).alias("win")).agg(F.count("*").alias("new_sources"))
