"""SimHash near-duplicates: fingerprints are sharded by a vantage-point tree, and shards are searched for exact pairs.

A node of the tree is a vantage point and a distance t. By the triangle inequality, a fingerprint at distance d from the
vantage point has all its neighbours within b bits at distances d - b to d + b. So the branch of larger distances is pruned
for those with d <= t, that of smaller ones for those with d > t + b, and only the fingerprints between go to both: each
linked pair meets whole in some leaf. Leaves are shards, dealt over tasks. Within a shard blocks of bits speed up the
search: fingerprints that differ in at most b bits agree in one of b + 1 blocks, and each run of one block value is searched
by vantage points again where it is long, else compared directly. No link is lost, and no group's pairs are emitted: a
shard gives a spanning star for each of its components.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import arrow_map, discard, hot_keys, quoted, spread_join, stored, table, utf8, without

#: Fingerprints of a shard at most (as the sample judges it). There are as many shards as parallel tasks if these are fewer
#: but not below LEAST_SHARD.
SHARD, LEAST_SHARD = 8_000_000, 512
#: Fingerprints drawn to fit the tree: one in SAMPLE_ONE_IN, and SAMPLE at most on average.
SAMPLE, SAMPLE_ONE_IN = 262_144, 4
#: A node is fitted on at least so many of the sample.
LEAST_SAMPLE = 64
#: Within a task: runs up to this length are compared pair by pair, vectorised over all runs.
SHORT_RUN = 96
#: Below this many a run is searched directly; a split that leaves more than this share on one side is not made.
LEAF, WORTH = 2_048, 0.8
#: Rows that a task holds at once; a shard is never cut.
HELD = 500_000


def fingerprint(value: bytes, words: int = 3) -> int:
    """The unsigned SimHash of a UTF-8 text: A-Z lower-cased, shingles of words joined by one space, XXH64 with seed 42."""
    tokens = value.lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map(len, tokens)))
    starts = [0, *[e + i for i, e in enumerate(ends[: n - 1], 1)]]
    stops = [e + i for i, e in enumerate(ends[words - 1 :], words - 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, *, text: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Add fp, the fingerprint's 64 bits as a signed long. A null or empty text, or one of white space, has fp 0."""

    def start():
        def compute(values):
            return [pa.array(np.array([fingerprint(v, words) for v in values], np.uint64).view(np.int64), pa.int64())]

        return compute

    return arrow_map(docs, [utf8(text)], "fp bigint", start, without(docs, []) if keep is None else keep)


def near(a: np.ndarray, b, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def split(points: np.ndarray, bits: int, candidates: int = 8):
    """The vantage point and boundary t that part points best: left is distance <= t + bits, right is > t, so that
    each pair within bits lies whole in one of them. None if no candidate leaves at most WORTH on both sides."""
    best = None
    for v in points[:: max(1, len(points) // candidates)][:candidates]:
        within = np.bincount(distances(points, v), minlength=65 + bits).cumsum()
        most = np.maximum(within[bits : bits + 65], len(points) - within[:65])
        t = int(most.argmin())
        if most[t] <= WORTH * len(points) and (best is None or most[t] < best[0]):
            best = (most[t], v, t)
    return best[1:] if best else None


def components(points: np.ndarray, bits: int) -> np.ndarray:
    """For distinct points, the position of a root each, equal for two just if links of at most bits join them."""
    roots = np.arange(len(points))
    a, b = [], []

    def direct(at: np.ndarray) -> None:
        """Breadth first; what is reached leaves the rest, so a dense group costs little."""
        rest = at
        while len(rest):
            seed, rest = rest[0], rest[1:]
            front = np.array([seed])
            while len(front) and len(rest):
                now, front = front[:64], front[64:]
                hit = near(points[now][:, None], points[rest][None, :], bits).any(axis=0)
                got, rest = rest[hit], rest[~hit]
                a.append(np.full(len(got), seed)), b.append(got)
                front = np.concatenate([front, got])

    todo = [roots]
    while todo:
        at = todo.pop()
        cut = split(points[at], bits) if len(at) > LEAF else None
        if cut is None:
            direct(at)
        else:
            d = distances(points[at], cut[0])
            todo += [at[d <= cut[1] + bits], at[d > cut[1]]]
    return joined(len(points), np.concatenate(a), np.concatenate(b)) if a else roots


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components under the links a-b."""
    roots = np.arange(n)
    while len(a):
        ra, rb = roots[a], roots[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(roots, up := roots[roots]):
            roots = up
    return roots


def blocks_of(bits: int) -> list[tuple[int, int]]:
    """Shift and mask of bits + 1 blocks of the 64 bits."""
    edges = [64 * i // (bits + 1) for i in range(bits + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]


def shard_stars(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's distinct fingerprints -> links from each component's first fingerprint to its others."""
    a, b = [], []
    for shift, mask in blocks_of(bits):
        value = fp.view(np.uint64) >> np.uint64(shift) & np.uint64(mask)
        order = np.argsort(value, kind="stable")
        value, points = value[order], fp.view(np.uint64)[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        length = np.diff(np.r_[first, len(value)])
        left = np.repeat(first + length, length) - np.arange(len(value))  # rows from here to the end of the run
        short = np.flatnonzero(np.repeat(length, length) <= SHORT_RUN)
        for s in range(1, SHORT_RUN):
            short = short[left[short] > s]
            if not len(short):
                break
            hit = short[near(points[short], points[short + s], bits)]
            a.append(order[hit]), b.append(order[hit + s])
        for at, n in zip(first[length > SHORT_RUN], length[length > SHORT_RUN], strict=True):
            roots = components(points[at : at + n], bits)
            member = np.flatnonzero(roots != np.arange(n))
            a.append(order[at + roots[member]]), b.append(order[at + member])
    roots = joined(len(fp), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(fp))
    member = np.flatnonzero(roots != np.arange(len(fp)))
    return fp[roots[member]], fp[member]


def stars(shard: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by shard, without repeats -> the stars of all shards."""
    ends = np.flatnonzero(np.r_[shard[1:] != shard[:-1], True]) + 1
    got = [shard_stars(fp[lo:hi], bits) for lo, hi in zip(np.r_[0, ends[:-1]], ends) if hi - lo > 1]
    return tuple(np.concatenate([fp[:0], *x]) for x in zip(*got)) if got else (fp[:0], fp[:0])


def fit_tree(sample: np.ndarray, bits: int, count: float, most: float, leaves: list):
    """Nested (vantage, t, left, right) over count points, or a leaf's number; sizes are judged by the sample."""
    cut = split(sample, bits) if count > most and len(sample) >= LEAST_SAMPLE else None
    if cut is None:
        leaves.append(count)
        return len(leaves) - 1
    d = distances(sample, cut[0])
    left, right = sample[d <= cut[1] + bits], sample[d > cut[1]]
    size = len(sample)
    return (*cut, fit_tree(left, bits, count * len(left) / size, most, leaves), fit_tree(right, bits, count * len(right) / size, most, leaves))


def descend(tree, points: np.ndarray, at: np.ndarray, bits: int, pruned: list):
    """(positions, leaf) for every leaf that holds or may be asked for some of points[at]. Branches that the triangle bound
    rules out, of the two at each node that a point reaches, are added to pruned."""
    if not isinstance(tree, tuple):
        yield at, tree
        return
    vantage, t, low, high = tree
    d = distances(points[at], vantage)
    left, right = at[d <= t + bits], at[d > t]
    pruned.append(2 * len(at) - len(left) - len(right))
    if len(left):
        yield from descend(low, points, left, bits, pruned)
    if len(right):
        yield from descend(high, points, right, bits, pruned)


def vantage_tree(fps: DataFrame, bits: int, shard: int = SHARD):
    """The tree over distinct fingerprints fp and its number of leaves, fitted on a bounded sample drawn by a hash. All
    fingerprints are routed by it. It has a shard a parallel task, or more where these would exceed shard fingerprints."""
    n = fps.count()
    share = min(1 / SAMPLE_ONE_IN, SAMPLE / max(n, 1))
    drawn = fps.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas()
    sample = np.sort(drawn["fp"].to_numpy(np.int64).view(np.uint64))
    sample = np.random.default_rng(len(sample)).permutation(sample)  # candidates come from all over, whatever the order
    leaves: list[float] = []
    tree = fit_tree(sample, bits, n, min(shard, max(n / fps.sparkSession.sparkContext.defaultParallelism, LEAST_SHARD)), leaves)
    return tree, len(leaves)


def routed(fps: DataFrame, tree, bits: int) -> DataFrame:
    """fp -> shard, fp for every leaf that a fingerprint's ball of radius bits meets."""
    sent = fps.sparkSession.sparkContext.broadcast(tree)  # a few numbers a leaf

    def route(batches):
        own = sent.value

        def dealt(held):
            fp = np.concatenate(held)
            for at, leaf in descend(own, fp.view(np.uint64), np.arange(len(fp)), bits, []):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int64)), pa.array(fp[at])], names=["shard", "fp"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            rows += batch.num_rows
            if rows >= HELD:
                yield from dealt(held)
                held, rows = [], 0
        if rows:
            yield from dealt(held)

    return fps.select("fp").mapInArrow(route, "shard bigint, fp bigint")


def links(fps: DataFrame, bits: int = 3, shard: int = SHARD) -> DataFrame:
    """Distinct fingerprints fp -> links a, b that join just those which chains of links of at most bits join."""
    if bits < 1:  # distinct fingerprints differ
        return fps.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    tree, leaves = vantage_tree(fps, bits, shard)

    def search(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                got = pa.Table.from_batches(held).combine_chunks()
                ids = got.column("shard").to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))  # the last shard may go on
                if cut:
                    yield linked(got.slice(0, cut))
                    held, rows = got.slice(cut).to_batches(), len(ids) - cut
        if rows:
            yield linked(pa.Table.from_batches(held))

    def linked(got: pa.Table) -> pa.RecordBatch:
        a, b = stars(got.column("shard").to_numpy(), got.column("fp").to_numpy(), bits)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    tasks = min(leaves, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return routed(fps, tree, bits).repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(search, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """Links a, b -> node, root (the least node of its component), by label passing with pointer jumps.

    Each round is written to the shared folder, and the one before is removed; the rounds grow with the logarithm of the
    longest chain. Nodes with many links, and roots of many nodes, are broadcast (spread_join).
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    roots = stored(both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")), "roots")
    nodes, hubs = roots.count(), hot_keys(both, "other")
    while True:
        seen = spread_join(both, roots.select(F.col("node").alias("other"), "root"), "other", hubs).groupBy("node").agg(F.min("root").alias("seen"))
        passed = stored(roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root")), "passed")
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = stored(spread_join(passed, up, "root", hot_keys(passed, "root", nodes)).select("node", "old", F.least("root", "above").alias("root")), "roots")
        discard(spark, roots, passed)
        roots = jumped.select("node", "root")
        roots.stored_at = jumped.stored_at
        if jumped.where("root < old").isEmpty():
            discard(spark, both)
            return roots


def groups_of(light: DataFrame, bits: int, shard: int = SHARD) -> DataFrame:
    """Rows of fp and __id -> one row a fingerprint with its component_id, stored."""
    spark = light.sparkSession
    fps = stored(light.groupBy("fp").agg(F.min("__id").alias("least")), "distinct")
    edges = stored(links(fps.select("fp"), bits, shard), "stars")
    roots = connected(edges)
    member = stored(roots.join(fps, roots.node == fps.fp).select("fp", "root", "least"), "members")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = spread_join(member, least, "root").select("fp", "component_id")
    found = stored(fps.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "groups")
    discard(spark, fps, edges, roots, member)
    return found


def marked_rows(docs: DataFrame, id_col: str, text: str, words: int, keep: list[str]) -> DataFrame:
    """The columns keep as c0, c1, ... (so no name can clash), __id, fp and a row number, written to the shared folder, so all
    are settled and computed once."""
    plain = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], quoted(id_col).alias("__id"), quoted(text).alias("__text"))
    numbered = plain.withColumn("__row", F.monotonically_increasing_id())
    return stored(add_fingerprint(numbered, text="__text", words=words, keep=[c for c in numbered.columns if c != "__text"]), "fingerprints")


def named_back(marked: DataFrame, keep: list[str], *more: str) -> DataFrame:
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *more)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, bits: int = 3, keep: list[str] | None = None, shard: int = SHARD
) -> DataFrame:
    """Add fp and component_id: the least id that chains of fingerprints at most bits apart reach from a row.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows and ids stay and are in one
    component; a null id never names a component unless all its ids are null. Short texts are one shingle. An empty
    table gives an empty one. Columns named as an output are replaced; texts are read whole, whatever their length.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c in set(without(docs, ["fp", "component_id"]))]
    marked = marked_rows(docs, id_col, text, words, keep)
    return named_back(spread_join(marked, groups_of(marked.select("fp", "__id"), bits, shard), "fp"), keep, "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of docs that name their component: one document of each group, with all of its columns, whatever their names.

    Of rows that repeat an id one stays. A component without any id keeps one row a fingerprint. Groups are found on
    ids and fingerprints alone; then texts move once, dealt by row, so a large group is spread. An empty table gives an
    empty one.
    """
    marked = marked_rows(docs, id_col, text, words, docs.columns)
    light = marked.select("fp", "__id", "__row")
    named = spread_join(light, groups_of(light, bits), "fp").where(F.col("__id").eqNullSafe(F.col("component_id")))
    winners = named.groupBy("fp", "__id").agg(F.min("__row").alias("__row")).select("__row")
    return named_back(marked.join(winners, "__row", "left_semi"), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
