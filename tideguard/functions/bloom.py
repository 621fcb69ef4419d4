"""Blocked Bloom filters as tables: built by an aggregate, merged by another, and tested by a join that moves no tested row.

A key sets eight bits in one block of 256, one in each 32-bit half of four words. Filters have at most MOST_BLOCKS blocks, 8 MB,
so a filter may be broadcast however many keys it holds; a fuller one only lets more keys pass falsely.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.functions.columns import quoted, spare

BITS_PER_KEY, BLOCK_BITS, MOST_BLOCKS = 16, 256, 1 << 18
WORDS = ("w0", "w1", "w2", "w3")


def blocks_for(n: int) -> int:
    """Blocks of a filter of n keys: a false share of about 1 in 1,000 until there are MOST_BLOCKS."""
    return min(MOST_BLOCKS, 1 << ceil(log2(max(1, n * BITS_PER_KEY / BLOCK_BITS))))


def hashed(keys: Sequence[str]) -> str:
    return ", ".join("`" + k.replace("`", "``") + "`" for k in keys)


def block_of(keys: Sequence[str], blocks: int) -> str:
    return f"pmod(xxhash64({hashed(keys)}), {blocks})"


def words_of(keys: Sequence[str]) -> list[str]:
    """SQL of the four 64-bit words that a key sets bits in."""
    bits = [f"cast(shiftright(xxhash64({hashed(keys)}, 'bits'), {5 * i}) & 31 as int)" for i in range(8)]
    return [f"shiftleft(1L, {bits[2 * j]}) | shiftleft(1L, 32 + {bits[2 * j + 1]})" for j in range(4)]


def bloom_filter(entries: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """(block, w0 to w3), partly summed where the entries are; blocks without an entry have no row."""
    bits = entries.select(F.expr(block_of(keys, blocks)).alias("block"), *[F.expr(x).alias(w) for w, x in zip(WORDS, words_of(keys))])
    return merged(bits)


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of several with as many blocks."""
    together = filters[0]
    for more in filters[1:]:
        together = together.unionByName(more)
    return together.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def tested(df: DataFrame, keys: Sequence[str], bloom: DataFrame, blocks: int, name: str) -> DataFrame:
    """df with a boolean column of that name: false if the filter surely lacks the row's key."""
    block, *words = (spare(f"__{c}", [*df.columns, name]) for c in ("block", *WORDS))
    renamed = F.broadcast(bloom.select(F.col("block").alias(block), *[F.col(w).alias(x) for w, x in zip(WORDS, words)]))
    found = df.withColumn(block, F.expr(block_of(keys, blocks))).join(renamed, block, "left")
    passes = " and ".join(f"coalesce({x} & ({bits}) = ({bits}), false)" for x, bits in zip(words, words_of(keys)))
    return found.select(*[quoted(c) for c in df.columns], F.expr(passes).alias(name))
