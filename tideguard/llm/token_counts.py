"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, sent to the tasks as a bounded broadcast; tier
two is a cache in each Python worker, which asks the tokenizer for what neither holds. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame

from tideguard.llm.common import arrow_map, discard, stored, table, utf8, without

#: Entries of the broadcast table at most, entries of a task's summary, and summaries that one merge takes. None changes a result.
FREQUENT, FREQUENT_PER_TASK, FAN_IN = 32_768, 8_192, 64
#: One document in so many feeds the table of frequent pre-tokens.
SAMPLE_ONE_IN = 64
#: Entries of one worker's cache; when it is full it starts anew.
CACHE = 400_000
LONGEST_CACHED = 64
SPACED = re.compile("(?<=[^ ]) ")


def piece_splits(text: str) -> list[str]:
    """Cut a text where no token of a white-space-escaping piece model can span: at a space that follows a non-space.

    Each part, encoded on its own, regains that space as the model's leading mark. This needs a vocabulary in which
    the mark only starts a piece or fills it, which load() checks.
    """
    if "▁" in text:
        text = text.replace("▁", " ")
    return SPACED.split(text) if "  " in text or text[:1] == " " else text.split(" ")


@lru_cache(maxsize=4)
def load(path: str):
    """path -> (split(text) into parts that encode independently, length of one part)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            return (lambda text: [text]), lambda part: len(model.encode(part))
        # the empty part is what follows a space at the very end: the mark alone
        return piece_splits, lambda part: len(model.encode(part)) if part else 1
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda text: [text]), lambda part: len(model.encode(part, add_special_tokens=False).ids)


class Lengths(dict):
    """part -> number of tokens; what is missing is encoded, and kept unless it is long."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.frequent = frequent
        self.split, self.encode = load(path)

    def __missing__(self, part: str) -> int:
        n = self.encode(part)
        if len(part) <= LONGEST_CACHED and "\n" not in part:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[part] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split(text))) if text else 0


#: The worker's cache outlives a task; another model or table starts a new one.
_WORKER: dict[tuple, Lengths] = {}


def worker_lengths(path: str, frequent) -> Lengths:
    key = (path, frequent.id if hasattr(frequent, "id") else id(frequent))
    if key not in _WORKER:
        _WORKER.clear()
        words, lengths = frequent.value
        _WORKER[key] = Lengths(path, dict(zip(words.split("\n"), lengths, strict=True)) if lengths else {})
    return _WORKER[key]


SUMMARY = "parts array<string>, counts array<bigint>, lengths array<int>, seen bigint"


def summary(counts: Counter, lengths: dict[str, int], seen: int):
    """The most frequent parts as one row, FREQUENT at most."""
    import pyarrow as pa

    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
    row = {"parts": [p for p, _ in top], "counts": [n for _, n in top], "lengths": [lengths[p] for p, _ in top], "seen": seen}
    return pa.RecordBatch.from_pylist([row], pa.schema([("parts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("seen", pa.int64())]))


def merged(rows) -> tuple[Counter, dict[str, int], int]:
    counts: Counter[str] = Counter()
    lengths: dict[str, int] = {}
    seen = 0
    for row in rows:
        for part, n in zip(row["parts"], row["counts"], strict=True):
            counts[part] += n
        lengths.update(zip(row["parts"], row["lengths"], strict=True))
        seen += row["seen"]
    return counts, lengths, seen


def frequent_lengths(docs: DataFrame, text: str, path: str) -> tuple[str, bytes]:
    """The frequent pre-tokens of one document in SAMPLE_ONE_IN, newline-joined, and their lengths as bytes.

    Each task makes one row, a summary of its FREQUENT_PER_TASK most frequent ones and of how many it has seen. Summaries are
    merged, FAN_IN at a time, into one that the driver takes; no pre-token is the key of a shuffle. Those that make up at
    least one FREQUENTth of all are taken, so there are at most FREQUENT. Only the speed depends on them.
    """
    sample = docs.sample(1 / SAMPLE_ONE_IN, seed=42)

    def local(batches):
        split, encode = load(path)
        counts: Counter[str] = Counter()
        seen = 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                parts = split(value.decode("utf-8", "replace"))
                seen += len(parts)
                counts.update(p for p in parts if "\n" not in p and len(p) <= LONGEST_CACHED)
            if len(counts) > 40 * FREQUENT_PER_TASK:
                counts = Counter(dict(counts.most_common(20 * FREQUENT_PER_TASK)))
        if seen:
            counts = Counter(dict(counts.most_common(FREQUENT_PER_TASK)))
            yield summary(counts, {p: encode(p) for p in counts}, seen)

    def merge(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            yield summary(*merged(rows))

    found = stored(sample.select(utf8(text).alias("v")).mapInArrow(local, SUMMARY), "frequent")
    while (n := found.count()) > 1:
        before, found = found, stored(found.repartition(-(-n // FAN_IN)).mapInArrow(merge, SUMMARY), "frequent")
        discard(docs.sparkSession, before)
    counts, lengths, seen = merged(found.toArrow().to_pylist())
    discard(docs.sparkSession, found)
    top = sorted(p for p, n in counts.items() if n * FREQUENT >= seen and lengths[p] < 256)
    return "\n".join(top), bytes(lengths[p] for p in top)


def count_tokens(docs: DataFrame, model: str, *, text: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to every row.

    A null text counts as empty: 0 bytes, 0 tokens. Rows are neither merged nor reordered, so repeated rows and
    ids stay; texts of any length are counted whole; columns named as an output are replaced. An empty table
    gives an empty one. model is the path of a sentencepiece .model or a tokenizers .json file, which must exist on
    every executor; special strings inside texts are treated as that library does by default.
    """
    keep = without(docs, []) if keep is None else keep
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, model))

    def start():
        lengths = worker_lengths(model, frequent)

        def compute(values):
            n = [lengths.count(v.decode("utf-8", "replace")) for v in values]
            return [len(v) for v in values], n, [x > limit for x in n]

        return compute

    return arrow_map(docs, [utf8(text)], "n_bytes bigint, n_tokens bigint, over_limit boolean", start, keep)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
