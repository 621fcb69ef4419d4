"""Cross-tokenizer alignment by products of token-byte incidence matrices.

Rows of A and B are the tokens of two tokenizers, columns the bytes of a text. The product of A and B transposed holds, for each
pair of tokens, how many bytes they share: its entries are the links. Where both tokenizers end a token the text is cut into
groups, and products of token-group incidences tell which tokens share one. Matrices are held as compressed sparse rows (CSR).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.best_fit import byte_ranks
from tideguard.llm.common import discard, extended, quoted, stored, table, utf8, without

#: Parts whose alignment one worker keeps, and their most characters; parts that are aligned in one product, by their characters.
CACHE, LONGEST_CACHED, AT_ONCE = 250_000, 48, 32_000
#: Pairs that hold at least one in so many of all (document, pair) rows are sent to the tasks: so many at most, 16 bytes each.
FREQUENT = 1 << 19
#: A space between two characters that are no white space: no token of either tokenizer goes across it.
CUT = re.compile(r"(?<=\S) (?=\S)")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class Csr(NamedTuple):
    """A sparse matrix: row i has the columns indices[starts[i]:starts[i + 1]] with these values."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray


def product(a: Csr, b: Csr, width: int) -> Csr:
    """a times b, which has width columns, by Gustavson's rule: row i is the sum of b's rows at the columns of a's row i.

    All rows are summed at once: the terms are laid out row by row, brought into column order within a row, and added up.
    """
    each = np.diff(b.starts)[a.indices]
    rows = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), each)
    total = len(rows)
    within = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
    at = np.repeat(b.starts[:-1][a.indices], each) + within
    key = rows * width + b.indices[at]
    value = np.repeat(a.values, each) * b.values[at]
    if total and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1)) if total else np.empty(0, np.int64)
    values = np.add.reduceat(value, first) if total else value
    rows, columns = np.divmod(key[first], max(1, width))
    starts = np.searchsorted(rows, np.arange(len(a.starts)))
    return Csr(starts, columns, values)


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token covers as many of the next bytes as it has."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64))


def transposed_incidence(lengths: np.ndarray) -> Csr:
    """Bytes by tokens."""
    n = int(lengths.sum())
    return Csr(np.arange(n + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(n, np.int64))


def membership(group: np.ndarray) -> Csr:
    """Tokens by groups: one entry a token."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64))


def members(group: np.ndarray, groups: int) -> Csr:
    """Groups by tokens; group numbers ascend."""
    return Csr(np.searchsorted(group, np.arange(groups + 1)), np.arange(len(group)), np.ones(len(group), np.int64))


def shared_links(group_a: np.ndarray, group_b: np.ndarray, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """The pairs (A token, B token) of one group, from products of so many rows of the token-group incidence at once."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    right = members(group_b, n)
    for at in range(0, len(group_a), rows):
        found = product(membership(group_a[at : at + rows]), right, len(group_b))
        yield from zip((np.repeat(np.arange(len(found.starts) - 1), np.diff(found.starts)) + at).tolist(), found.indices.tolist(), strict=True)


class Tokens(NamedTuple):
    """What a tokenizer gives: ids of each text of a list, and the bytes of an id."""

    encode: object
    bytes: list
    splits: bool


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokens:
    """A byte-level BPE of the tokenizers library; special strings in a text are plain text."""
    said = json.load(open(path, encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = {i: t for t, i in said["model"]["vocab"].items()}
    entries = [bytes(byte.get(c, 0) for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
    ranks = byte_ranks(said["model"])
    pre = said.get("pre_tokenizer") or {}
    if ranks and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer"):
        import public_tokenizers
        import tiktoken

        fast = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Tokens(lambda texts: [fast.encode_ordinary(t) for t in texts], entries, True)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = True
    return Tokens(lambda texts: [model.encode(t, add_special_tokens=False).ids for t in texts], entries, False)


@lru_cache(maxsize=4)
def pieces(path: str) -> Tokens:
    """A sentencepiece model, which itself puts a space before a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    entries = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
    splits = not any("▁" in p.lstrip("▁") for p in names)
    return Tokens(lambda texts: model.encode(texts, num_threads=1), entries, splits)


#: What is known of a part: tokens of A and of B, groups, shared-group links, the written groups, and A id * 2^32 + B id of each link as bytes.
Part = tuple[int, int, int, int, bytes, bytes]


def enders(n: int, marks: str) -> np.ndarray:
    """The decimal of each id under n followed by each mark: that of mark k at id + k * n."""
    return np.array([f"{i}{m}" for m in marks for i in range(n)], object)


class Aligner(dict):
    """part of a text -> its Part, or None if the tokens' bytes aren't the text's; from a cache of bounded size."""

    def __init__(self, path_a: str, path_b: str):
        super().__init__()
        self.a, self.b = byte_level(path_a), pieces(path_b)
        self.splits = self.a.splits and self.b.splits
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # an id is followed by another of its side, by the other side, and on B's side by the next group or the end of the part
        self.names_a, self.names_b = enders(len(self.len_a), ",|"), enders(len(self.len_b), ",;\n")

    def cut(self, text: str) -> list[str]:
        """Parts that both tokenizers encode as they do within the text; each regains the space before it."""
        return CUT.split(text) if self.splits else [text]

    def tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both tokenizers for parts beside each other, or None if either's tokens don't spell them."""
        joined = " ".join(parts)
        a, b = self.a.encode([" " + joined])[0], self.b.encode([joined])[0]
        data = (" " + joined).encode("utf-8", "replace")
        if b"".join(map(self.a.bytes.__getitem__, a)) == data == b"".join(map(self.b.bytes.__getitem__, b)):
            return np.array(a, np.int64), np.array(b, np.int64)
        return None

    def align(self, parts: list[str]) -> list[Part | None]:
        """Parts that may stand in one text, one after the other, aligned in one pair of products. If their tokens don't spell
        them, halves are tried, down to the parts to blame."""
        ends = np.cumsum([len(p.encode("utf-8", "replace")) + 1 for p in parts])
        ids = self.tokens(parts)
        if ids is None:
            half = len(parts) // 2
            return self.align(parts[:half]) + self.align(parts[half:]) if half else [None]
        ids_a, ids_b = ids
        len_a, len_b = self.len_a[ids_a], self.len_b[ids_b]
        links = product(incidence(len_a), transposed_incidence(len_b), len(ids_b))
        keys = ((np.repeat(ids_a, np.diff(links.starts)) << 32) | ids_b[links.indices]).tobytes()
        end_a, end_b = len_a.cumsum(), len_b.cumsum()
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        # tokens by groups, times groups by how many B tokens they have: an A token's shared-group links
        sizes = Csr(np.arange(len(both) + 1), np.zeros(len(both), np.int64), np.bincount(group_b, minlength=len(both)))
        shared = np.concatenate(([0], product(membership(group_a), sizes, 1).values.cumsum()))
        last_a, last_b = (np.diff(g, append=len(both)) > 0 for g in (group_a, group_b))
        closes = last_b & np.isin(end_b, ends, assume_unique=True)
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        names = np.concatenate((self.names_a[ids_a + len(self.len_a) * last_a], self.names_b[ids_b + len(self.len_b) * (last_b + 0 + closes)]))
        written = "".join(names[order].tolist()).encode().split(b"\n")
        to_a, to_b, to_group = (np.searchsorted(e, ends, "right") for e in (end_a, end_b, both))
        to_link = 8 * links.starts[to_a]
        n_a, n_b, n_groups, n_shared = (np.diff(x, prepend=0).tolist() for x in (to_a, to_b, to_group, shared[to_a]))
        own = [keys[i:j] for i, j in zip([0, *to_link.tolist()], to_link.tolist())]
        return list(zip(n_a, n_b, n_groups, n_shared, written, own))

    def fill(self, texts: list[list[str]]) -> dict[str, Part | None]:
        """Align all parts that the cache lacks. Long ones are returned, not kept."""
        if len(self) >= CACHE:
            self.clear()
        missing = [p for p in set(chain.from_iterable(texts)) if p not in self]
        # what begins or ends with white space can't stand beside another part
        edges = {p for parts in texts if parts for p in (parts[0], parts[-1]) if p[0].isspace() or p[-1].isspace()}
        alone = [p for p in missing if p in edges] if self.splits else missing
        found: dict[str, Part | None] = dict(zip(alone, (self.align([p])[0] for p in alone)))
        rest = [p for p in missing if p not in found] if alone else missing
        at = 0
        while at < len(rest):
            to, size = at, 0
            while to < len(rest) and (to == at or size + len(rest[to]) <= AT_ONCE):
                size += len(rest[to])
                to += 1
            found.update(zip(rest[at:to], self.align(rest[at:to]), strict=True))
            at = to
        apart = {p: x for p, x in found.items() if len(p) > LONGEST_CACHED}
        self.update((p, x) for p, x in found.items() if len(p) <= LONGEST_CACHED)
        return apart


_WORKER: dict[tuple[str, str], Aligner] = {}


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _WORKER:
        _WORKER.clear()
        _WORKER[path_a, path_b] = Aligner(path_a, path_b)
    return _WORKER[path_a, path_b]


NOTHING = (0, 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
COUNTED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_group_links bigint, groups_sha256 string"
#: Texts whose parts are aligned together, by their characters.
TEXTS_AT_ONCE = 2_000_000


def aligned(aligner: Aligner, texts: list[str]) -> list[tuple]:
    """For each text the columns of COUNTED, and its different id pairs with how many links have them."""
    cut = [aligner.cut(t) if t else [] for t in texts]
    apart = aligner.fill(cut)
    rows = []
    for parts in cut:
        try:
            got = list(map(aligner.__getitem__, parts))
        except KeyError:  # a long part
            got = [apart[p] if p in apart else aligner[p] for p in parts]
        if not got or None in got:
            rows.append(NOTHING)
            continue
        n_a, n_b, n_groups, n_group_links, groups, keys = zip(*got)
        pairs, times = np.unique(np.frombuffer(b"".join(keys), np.int64), return_counts=True)
        rows.append((sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), sum(n_group_links), hashlib.sha256(b";".join(groups)).hexdigest(), pairs, times))
    return rows


def text_blocks(values: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for v in values:
        if block and size + len(v) > TEXTS_AT_ONCE:
            yield block
            block, size = [], 0
        block.append(v)
        size += len(v)
    if block:
        yield block


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the columns of COUNTED, pairs (A id * 2^32 + B id of each different linked pair) and times (its links) to every row.

    path_a is a byte-level tokenizers .json, which reads a space and the text; path_b a sentencepiece .model, which adds the space.
    A null or empty text, and one whose tokens don't spell it, has no tokens: zeros, '' and no pairs. Texts are
    read whole; rows are neither merged nor dropped; columns named as an output are replaced.
    """
    made = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "pairs", "times"]
    keep = [c for c in (docs.columns if keep is None else keep) if c in set(without(docs, made))]
    n, held = len(keep), [f"c{i}" for i in range(len(keep))]
    plan = docs.select(*[quoted(c).alias(h) for c, h in zip(keep, held)], utf8(text).alias("text"))

    def run(batches):
        aligner = worker_aligner(path_a, path_b)
        for batch in batches:
            values = [v.decode("utf-8", "replace") for v in batch.column(n).to_pylist()]
            at = 0
            for block in text_blocks(values):
                columns = list(zip(*aligned(aligner, block), strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string()), list_array(columns[6], pa.int64()), list_array(columns[7], pa.int32())]
                own = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*own.columns[:n], *arrays], names=[*held, *made])

    found = plan.mapInArrow(run, extended(plan.schema.fields[:n], f"{COUNTED}, pairs array<bigint>, times array<int>"))
    return found.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], *made)


def with_frequent(rows: DataFrame, keys: np.ndarray, numbers: np.ndarray, best: np.ndarray) -> DataFrame:
    """rows with n_best and count_sum over their frequent pairs, and the other pairs with their times."""
    sent = rows.sparkSession.sparkContext.broadcast((keys, numbers, best))
    plain = rows.drop("pairs", "times")
    rows = rows.select(*plain.columns, "pairs", "times")

    def run(batches):
        keys, numbers, best = sent.value
        for batch in batches:
            n = batch.num_columns - 2
            lists, times = batch.column(n), batch.column(n + 1).flatten().to_numpy().astype(np.int64)
            pairs = lists.flatten().to_numpy()
            offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            count = np.where(hit, numbers[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)
            top = hit & (count == best[pairs >> 32])

            def summed(values):
                return np.diff(np.concatenate(([0], np.cumsum(values)))[offsets])

            rest = np.concatenate(([0], np.cumsum(~hit)))[offsets].astype(np.int32)
            made = [pa.array(summed(times * top)), pa.array(summed(times * count))]
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x, t)) for x, t in ((pairs[~hit], pa.int64()), (times[~hit], pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made, *lists], names=[*batch.schema.names[:n], "n_best", "count_sum", "pairs", "times"])

    return rows.mapInArrow(run, extended(plain.schema.fields, "n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *, text: str = "text", keep: list[str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best and count_sum to every row.

    A pair's count is the number of rows that hold it linked. Texts are read once; their different pairs are stored, counted (partly where they are
    read), and looked up: the most frequent ones in a table of bounded size that goes to the tasks, the others, none of
    which is hot, by a join. Repeated rows count as rows of their own. A null or empty text, and one that its tokens
    don't spell, has zeros and ''. An empty table gives an empty one. Columns named as an output are replaced; others may have any name.
    """
    spark = docs.sparkSession
    made = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "n_best", "count_sum"]
    keep = [c for c in (docs.columns if keep is None else keep) if c in set(without(docs, made))]
    held = [f"c{i}" for i in range(len(keep))]
    plain = docs.select(*[quoted(c).alias(h) for c, h in zip(keep, held)], F.monotonically_increasing_id().alias("row"), quoted(text).alias("text"))
    rows = stored(align_documents(plain, path_a, path_b, keep=[*held, "row"]), "aligned", compression="zstd")
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_frequent = F.col("n") * frequent >= F.lit(total)
    top = counts.where(is_frequent).orderBy("pair").toArrow()  # frequent rows at most
    # a row for each id of A's vocabulary at most
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    best_rows = highest.toArrow()
    best = np.zeros(len(byte_level(path_a).bytes), np.int64)
    best[best_rows.column("a").to_numpy()] = best_rows.column("highest").to_numpy()
    part = stored(with_frequent(rows, top.column("pair").to_numpy(), top.column("n").to_numpy(), best), "looked-up", compression="zstd")
    discard(spark, rows)
    tail = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = counts.where(~is_frequent).withColumn("a", F.shiftright("pair", 32)).join(highest, "a")
    rare = rare.select("pair", "n", (F.col("n") == F.col("highest")).cast("bigint").alias("is_best"))
    more = tail.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    found = part.drop("pairs", "times").join(more, "row", "left")
    zero = F.lit(0).cast("bigint")
    found = found.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", zero)).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", zero))
    return found.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], *made)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
