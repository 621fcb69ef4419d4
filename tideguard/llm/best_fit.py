"""Best-fit packing of token sequences by hierarchical residual packing.

Partitions pack their pieces best-fit decreasing and emit the nearly full bins. The underfull ones are items of
the next round, in which each task merges the leavings of FAN_IN tasks, and so on up the tree.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import discard, extended, quoted, stored, table, utf8, without

#: Pieces that one task of the first round packs on average, and tasks whose leavings one task merges.
PIECES_PER_TASK, FAN_IN = 200_000, 8
#: A bin with no more free tokens than this is nearly full.
NEARLY_FULL = 8
CACHE, LONGEST_CACHED = 400_000, 48
#: White space other than the space and the newline.
ODD_SPACE = re.compile(r"[^\S \n]")
END = (0).to_bytes(4, "little")


@lru_cache(maxsize=4)
def encoder(path: str):
    """path of a tokenizers .json -> (special strings, encode(text) -> little-endian ids, the same for a part, whether texts may be split at spaces)."""
    import json

    import numpy as np
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    said = json.load(open(path, encoding="utf-8"))
    pre, normal = said.get("pre_tokenizer") or {}, said.get("normalizer")
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and normal is None
    specials = [t["content"] for t in said.get("added_tokens", [])]

    def encode(part: str) -> bytes:
        return np.asarray(model.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    ranks = byte_ranks(said["model"]) if byte_level else None
    if ranks is None:
        return specials, encode, encode, byte_level
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return specials, encode, lambda part: array("I", fast.encode_ordinary(part)).tobytes(), True


def byte_ranks(bpe: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes -> id, if ids rank the merges, so that a rank-based encoder gives the same ids."""
    vocab, merges = bpe["vocab"], bpe.get("merges", [])
    plain = bpe.get("type", "BPE") == "BPE" and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    if not plain or None in made or made != sorted(set(made)):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merged = set(made)
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if len(token) == 1 or i in merged}


class Ids(dict):
    """word -> the ids, as little-endian bytes, that it has after a space; from a cache of bounded size, else encoded."""

    def __init__(self, path: str):
        super().__init__()
        self.specials, self.whole, self.encode, self.splits = encoder(path)
        self.marks = {m: self.encode(m) for m in ".,;:!?"} if self.splits else {}

    def __missing__(self, word: str) -> bytes:
        if word[-1] in self.marks and word[-2:-1].isalnum():  # a mark after a letter or digit is a pre-token of its own
            return self[word[:-1]] + self.marks[word[-1]]
        ids = self.encode(" " + word)
        if len(word) <= LONGEST_CACHED and "\n" not in word:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """A text's ids. A byte-level model's pre-tokens never cross a space between two non-spaces, so there a
        text is cut; texts with special strings or with other white space beside a space are encoded whole."""
        if not text:
            return b""
        if not self.splits or any(s in text for s in self.specials):
            return self.whole(text)
        if "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or ODD_SPACE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


_WORKER: dict[str, Ids] = {}


def worker_ids(path: str) -> Ids:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Ids(path)
    return _WORKER[path]


def pieces(docs: DataFrame, model: str, *, text: str = "text", capacity: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """One row per piece of each row's ids plus the end id 0: piece, start, length and ids_crc32.

    A null or empty text is the end id alone. Only documents of more than capacity ids are cut; then the first
    piece takes the remainder and all others are full.
    """
    keep = without(docs, ["piece", "start", "length", "ids_crc32"]) if keep is None else keep
    plan = docs.select(*[quoted(c) for c in keep], utf8(text).alias("__text"))
    n = len(keep)

    def run(batches):
        ids = worker_ids(model)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(n)):
                data = ids.of(value.as_py().decode("utf-8", "replace")) + END
                total, at, k = len(data) // 4, 0, 0
                to = total % capacity or capacity
                while at < total:
                    rows.append(i), piece.append(k), start.append(at), length.append(to - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * to]))
                    at, to, k = to, to + capacity, k + 1
            own = batch.select(list(range(n))).take(pa.array(rows, pa.int64()))
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*keep, "piece", "start", "length", "ids_crc32"])

    return plan.mapInArrow(run, extended(plan.schema.fields[:n], "piece int, start bigint, length bigint, ids_crc32 bigint"))


def best_fit(sizes, capacity: int) -> list[tuple[int, int]]:
    """Best-fit decreasing over sizes in descending order: each item's (bin, offset). Bins are found by free space."""
    free: dict[int, list[int]] = {}
    spaces: list[int] = []
    placed, bins = [], 0
    for size in sizes:
        at = bisect_left(spaces, size)
        if at == len(spaces):
            where, space, bins = bins, capacity, bins + 1
        else:
            space = spaces[at]
            where = heapq.heappop(free[space])
            if not free[space]:
                del free[space], spaces[at]
        placed.append((where, capacity - space))
        if left := space - size:
            if left not in free:
                insort(spaces, left)
                free[left] = []
            heapq.heappush(free[left], where)
    return placed


def first_round(rows: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """Every piece with the bin and offset that best-fit decreasing gives it among the pieces dealt to its task."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        batches = list(batches)
        got = pa.Table.from_batches(batches) if batches else None
        if got is None or not got.num_rows:
            return
        got = got.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        bins, offsets = zip(*best_fit(got.column("length").to_pylist(), capacity), strict=True)
        got = got.append_column("bin", pa.array([(task << 40) + b for b in bins], pa.int64()))
        yield from got.append_column("offset", pa.array(offsets, pa.int64())).to_batches(max_chunksize=65_536)

    return rows.repartition(tasks).mapInArrow(run, extended(rows.schema.fields, "bin bigint, offset bigint"))


def merge_round(under: DataFrame, capacity: int) -> DataFrame:
    """One level of the tree: the underfull bins (bin, size, task) of FAN_IN tasks, best-fit as items.

    Of two bins that fit together one is at most half full, and best fit leaves at most one such bin a task. So a
    task needs, beside its few half-empty bins, no more bins of any one size than those: bins of one size are
    interchangeable. That bounds what a task reads by FAN_IN times the capacity and loses no merge.
    Returns bin, into, base (its offset there) of all bins that share a new bin.
    """
    group = under.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("bigint"))
    half = F.col("size") * 2 <= capacity
    needed = group.where(half).groupBy("task").agg(F.count("*").alias("needed"))
    ranked = group.join(needed, "task").selectExpr("*", "row_number() over (partition by task, size order by bin) as rank")
    chosen = ranked.where(half | (F.col("rank") <= F.col("needed"))).select("task", "bin", "size")

    def pack(pdf):
        pdf = pdf.sort_values(["size", "bin"], ascending=[False, True], ignore_index=True)
        placed = best_fit(pdf["size"].tolist(), capacity)
        pdf["place"], pdf["base"] = [b for b, _ in placed], [o for _, o in placed]
        pdf = pdf[pdf.groupby("place")["bin"].transform("size") > 1]
        pdf["into"] = pdf.groupby("place")["bin"].transform("min")
        return pdf[["bin", "into", "base", "size"]]

    return chosen.groupBy("task").applyInPandas(pack, "bin bigint, into bigint, base bigint, size bigint")


def pack_documents(
    docs: DataFrame,
    model: str,
    *,
    text: str = "text",
    capacity: int = 2048,
    keep: list[str] | None = None,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Pack all pieces of all rows into sequences of at most capacity tokens: adds piece, start, length, ids_crc32,
    sequence_id and offset, one row per piece.

    A null or empty text is the end id alone. Repeated rows are packed once each; a null id is carried along; very
    long texts are cut into full pieces after a first one with the remainder; ties between pieces of one length
    fall either way. An empty table gives an empty one. Columns named as an output are replaced; others may have any name.
    """
    made = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    keep = [c for c in (docs.columns if keep is None else keep) if c in set(without(docs, made))]
    held = [f"c{i}" for i in range(len(keep))]  # so that no name can clash
    plain = docs.select(*[quoted(c).alias(h) for c, h in zip(keep, held)], quoted(text).alias("text"))
    rows = stored(pieces(plain, model, capacity=capacity, keep=held), "pieces")
    tasks = max(1, -(-rows.count() // pieces_per_task))
    placed = stored(first_round(rows, tasks, capacity), "bins")
    discard(docs.sparkSession, rows)
    moved = None
    if tasks > 1:
        sizes = placed.groupBy("bin").agg(F.sum("length").alias("size"))
        nearly_full = F.col("size") >= capacity - NEARLY_FULL
        under = stored(sizes.where(~nearly_full).withColumn("task", F.shiftright("bin", 40)), "under")
    level = 0
    while tasks > 1:
        tasks, level = -(-tasks // FAN_IN), level + 1
        merged = stored(merge_round(under, capacity), "merged")
        step = merged.select("bin", "into", "base")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("base").alias("more"))
            moved = moved.join(later, "into", "left").select(
                "bin", F.coalesce("to", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
            )
            moved = stored(moved.unionByName(step.join(moved.select("bin"), "bin", "left_anti")), "moved")
        if tasks > 1:
            new = merged.groupBy(F.col("into").alias("bin")).agg(F.sum("size").alias("size")).where(~nearly_full)
            same = under.join(merged.select("bin"), "bin", "left_anti").select("bin", "size")
            task = F.floor(F.shiftright("bin", 40) / FAN_IN**level).cast("bigint")
            under = stored(same.unionByName(new).withColumn("task", task), "under")
    sequence, offset = F.col("bin"), F.col("offset")
    if moved is not None:
        placed = placed.join(moved, "bin", "left")
        sequence, offset = F.coalesce("into", "bin"), F.col("offset") + F.coalesce("base", F.lit(0))
    return placed.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
