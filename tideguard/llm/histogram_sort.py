"""Sharding by histogram sort: shards of near-equal bytes, each a range of keys, with one exchange of the rows.

The key is (hash of the text, hash of the id, row number), so equal texts are neighbours and are cut apart only where
one group is larger than the tolerance. Splitters are found by counting exact bytes below probes in every partition and
narrowing the probes around each target, which moves a few numbers a round and no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import extended, quoted, stored, table, utf8, without

#: Probes a splitter and round, and about the most rows that one task ranks (it sorts a few numbers a row, and spills if need be).
#: The splitters inside shards are as many as rows by ROWS_PER_CHUNK: some 25,000 for 5e10 rows, whose probes are 6 MB.
PROBES, ROWS_PER_CHUNK = 32, 2_000_000
#: A splitter may miss its target by this share of a shard; splits inside a shard, by rows, by more, as they balance only tasks.
TOLERANCE, INNER_TOLERANCE = 0.001, 0.2
KEYS = ["__k1", "__k2", "__k3"]
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def counts(keys: DataFrame, level: int, probes: dict[tuple, list[int]]) -> dict[tuple, tuple[list[int], list[int]]]:
    """For each key prefix of this length: exact (bytes, rows) of its rows below each probe of the next key column."""
    prefixes = list(probes)

    def local(batches):
        sums = [np.zeros((len(probes[p]) + 1, 2), np.int64) for p in prefixes]
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(level + 1)]
            size = batch.column(level + 1).to_numpy()
            for s, prefix in zip(sums, prefixes, strict=True):
                own = np.flatnonzero(np.logical_and.reduce([c == v for c, v in zip(cols, prefix)])) if prefix else slice(None)
                at = np.searchsorted(np.array(probes[prefix], np.int64), cols[level][own], "right")
                s[:, 0] += np.bincount(at, size[own], len(s)).astype(np.int64)
                s[:, 1] += np.bincount(at, minlength=len(s))
        rows = [(i, j, int(x), int(n)) for i, s in enumerate(sums) for j, (x, n) in enumerate(s) if n]
        yield pa.RecordBatch.from_pylist([dict(zip(("p", "at", "bytes", "n"), r)) for r in rows], pa.schema([("p", pa.int32()), ("at", pa.int32()), ("bytes", pa.int64()), ("n", pa.int64())]))

    found = keys.select(*KEYS[: level + 1], "size").mapInArrow(local, "p int, at int, bytes bigint, n bigint")
    sums = [np.zeros((len(probes[p]) + 1, 2), np.int64) for p in prefixes]
    for r in found.groupBy("p", "at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():
        sums[r.p][r["at"]] += (r.bytes, r.n)
    below = [s.cumsum(axis=0)[:-1] for s in sums]
    return {p: (b[:, 0].tolist(), b[:, 1].tolist()) for p, b in zip(prefixes, below, strict=True)}


def splitters(keys: DataFrame, targets: list[float], tolerances: list[float], total: int, rows: int) -> list[tuple[tuple, int, int]]:
    """For each target, in order: a key, and the exact bytes and rows below it, within tolerance of the target bytes
    if a boundary between two rows is."""
    # per target: prefix, then the open range of the next key column as (value, bytes below, rows below)
    state = [{"prefix": (), "lo": (LOWEST, 0, 0), "hi": (HIGHEST, total, rows)} for _ in targets]
    done: list = [None] * len(targets)
    while open_ := [i for i, d in enumerate(done) if d is None]:
        level = min(len(state[i]["prefix"]) for i in open_)
        now = [i for i in open_ if len(state[i]["prefix"]) == level]
        probes: dict[tuple, set[int]] = {}
        for i in now:
            lo, hi = state[i]["lo"][0], state[i]["hi"][0]
            probes.setdefault(state[i]["prefix"], set()).update(lo + (hi - lo) * k // (PROBES + 1) for k in range(1, PROBES + 1))
        asked = {p: sorted(x) for p, x in probes.items()}
        got = counts(keys, level, asked)
        for i in now:
            s = state[i]
            base = s.get("base", (0, 0))
            values, sizes, numbers = asked[s["prefix"]], *got[s["prefix"]]
            above = bisect_right(sizes, targets[i] - base[0])  # bytes below probes ascend
            if above and values[above - 1] > s["lo"][0]:
                s["lo"] = (values[above - 1], sizes[above - 1] + base[0], numbers[above - 1] + base[1])
            if above < len(values) and values[above] < s["hi"][0]:
                s["hi"] = (values[above], sizes[above] + base[0], numbers[above] + base[1])
            near = min((s["lo"], s["hi"]), key=lambda x: abs(x[1] - targets[i]))
            single = s["hi"][2] - s["lo"][2] <= 1  # one row is left between the bounds, and no cut goes through it
            if single or abs(near[1] - targets[i]) <= tolerances[i] or s["hi"][0] - s["lo"][0] <= 1 and level + 1 == len(KEYS):
                done[i] = ((*s["prefix"], near[0], *[LOWEST] * (len(KEYS) - level - 1)), near[1], near[2])
            elif s["hi"][0] - s["lo"][0] <= 1:  # one key value spans the target: cut inside its rows
                state[i] = {"prefix": (*s["prefix"], s["lo"][0]), "base": s["lo"][1:], "lo": (LOWEST, *s["lo"][1:]), "hi": (HIGHEST, *s["hi"][1:])}
    return done


def place(cols: list[np.ndarray], keys: list[tuple]) -> np.ndarray:
    """How many of the sorted keys are at or below each row, by lexicographic order."""
    firsts = np.array([k[0] for k in keys], np.int64)
    at = np.searchsorted(firsts, cols[0], "right")
    if len(cols) > 1:
        for v in np.unique(firsts):
            own = np.flatnonzero(cols[0] == v)
            if len(own):
                lo = int(np.searchsorted(firsts, v))
                at[own] = lo + place([c[own] for c in cols[1:]], [k[1:] for k in keys if k[0] == v])
    return at


def chunks_of(keyed: DataFrame, total: int, rows: int, shards: int, tolerance: float, rows_per_chunk: int) -> tuple[list[tuple], list[int], list[int], list[int]]:
    """The sorted keys that cut shards by bytes, and each shard by rows into chunks of about rows_per_chunk at most; for each
    chunk the rows before it, its shard, and the rows before that."""
    if not rows:
        return [], [0], [0], [0]
    each = total / shards
    found = splitters(keyed, [each * i for i in range(1, shards)], [each * tolerance] * (shards - 1), total, rows)
    bounds = [0, *[n for _, _, n in found], rows]
    targets, tolerances = [], []
    for lo, hi in zip(bounds, bounds[1:]):
        parts = max(1, -(-(hi - lo) // rows_per_chunk))
        targets += [lo + (hi - lo) * k / parts for k in range(1, parts)]
        tolerances += [(hi - lo) / parts * INNER_TOLERANCE] * (parts - 1)
    inner = splitters(keyed.withColumn("size", F.lit(1).cast("bigint")), targets, tolerances, rows, rows)
    marked = sorted([(key, n, 1) for key, _, n in found] + [(key, n, 0) for key, _, n in inner])
    before, shard_of, ahead = [0], [0], [0]
    for _, n, new in marked:
        before.append(n)
        shard_of.append(shard_of[-1] + new)
        ahead.append(n if new else ahead[-1])
    return [key for key, _, _ in marked], before, shard_of, ahead


def shard_documents(
    docs: DataFrame,
    *,
    shards: int = 16,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law) to every row.

    size is the text's UTF-8 bytes plus 1, so null and empty texts (both 1) count too. Equal texts stay in one
    shard unless they cross a boundary by more than the tolerance; ties and repeated rows are told apart by a row
    number, so even one text in all rows is dealt evenly. No boundary cuts a row: one longer than a shard makes an
    uneven shard. An empty table gives an empty one. Columns named as an output are replaced; others may have any name.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in (docs.columns if keep is None else keep) if c in set(without(docs, made))]
    held = [f"c{i}" for i in range(len(keep))]  # so that no name can clash
    data = utf8(text)
    keyed = docs.select(
        *[quoted(c).alias(h) for c, h in zip(keep, held)],
        F.length(data).cast("bigint").__add__(F.lit(1)).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("__k1"),
        F.xxhash64(quoted(id_col)).alias("__k2"),
        F.monotonically_increasing_id().alias("__k3"),
    )
    keyed = stored(keyed, "keys")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts, before, shard_of, ahead = chunks_of(keyed, total, rows, shards, tolerance, rows_per_chunk)

    def deal(batches):
        starts, owner, first = (np.array(x, np.int64) for x in (before, shard_of, ahead))
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in KEYS]
            chunk = place(cols, cuts) if cuts else np.zeros(batch.num_rows, np.int64)
            yield batch.append_column("__chunk", pa.array(chunk, pa.int64())).append_column("shard", pa.array(owner[chunk], pa.int32())).append_column(
                "__before", pa.array(starts[chunk] - first[chunk], pa.int64())
            )

    dealt = keyed.mapInArrow(deal, extended(keyed.schema.fields, "__chunk bigint, shard int, __before bigint"))
    rank = F.expr(f"row_number() over (partition by __chunk order by {', '.join(KEYS)})")
    return dealt.withColumn("slot", F.col("__before") + rank - 1).select(
        *[F.col(h).alias(c) for c, h in zip(keep, held)], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
