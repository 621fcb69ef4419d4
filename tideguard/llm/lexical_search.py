"""Ranked lexical search with posting lists that are blocked by the documents' geometry.

Documents are dealt over segments. In a segment each posting list that a query may need is clustered by the similarity of its
documents, and each block has a summary: the largest impact of every term in any of its documents. A query's product with a summary
bounds the scores of the block, so a block is skipped only if that bound is below the score that a result needs; all other
blocks' documents are scored exactly. A list stays closed if its document's other terms can't make up the same score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tideguard.llm.common import discard, quoted, stored, table, utf8
from tideguard.llm.token_align import Csr, product

#: Queries are searched in blocks of so many items and different terms at most (or one item), which bounds what the tasks are sent.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 1_024, 32_768
#: A segment is closed once it has so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4_096, 500_000
#: Documents of a block, about; dimensions of the sketches that are clustered; documents that give the first thresholds.
BLOCK, DIMENSIONS, SEED_DOCS = 8, 32, 16_384
HIGHEST = (1 << 63) - 1
# A term is made of letters and digits of ASCII and of all characters beyond it; A-Z are lower-cased.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(TERM_BYTES).split()


class Items(NamedTuple):
    """A block of queries: item i has the different terms terms[starts[i]:starts[i + 1]], each so many times."""

    ids: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[i], self.starts[i + 1])
        return self.terms[own], self.times[own]


class Corpus(NamedTuple):
    """What all scores need: documents with a term, their terms with repeats, and the weight of each term of the vocabulary."""

    documents: int
    tokens: int
    weights: np.ndarray


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Rows of items come to the driver one by one and go on in blocks of bounded size."""

    def made(block: list) -> Items:
        vocabulary: dict[bytes, int] = {}
        numbers = [[(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in sorted(c.items())] for _, c in block]
        starts = np.cumsum([0, *map(len, numbers)])
        flat = np.array([x for row in numbers for x in row], np.int64).reshape(-1, 2)
        return Items([i for i, _ in block], vocabulary, starts, flat[:, 0], flat[:, 1])

    block: list = []
    held: set[bytes] = set()
    for row in items.select(quoted(item_id).alias("id"), utf8(text).alias("text")).toLocalIterator():
        counts = Counter(terms_of(bytes(row.text)))
        if block and (len(block) == ITEMS_AT_ONCE or len(held | counts.keys()) > TERMS_AT_ONCE):
            yield made(block)
            block, held = [], set()
        block.append((row.id, counts))
        held |= counts.keys()
    if block:
        yield made(block)


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """segment, id, n (terms with repeats), and the terms of the vocabulary with how often each occurs; documents without any term are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "segment bigint, id bigint, n bigint, terms array<int>, tf array<int>"

    def run(batches):
        from pyspark import TaskContext

        find = sent.value.get
        segment, documents, postings = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(data)
                if not words:
                    continue
                counts = Counter(map(find, words))
                counts.pop(None, None)
                if documents >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    segment, documents, postings = segment + 1, 0, 0
                documents, postings = documents + bool(counts), postings + len(counts)
                held = sorted(counts)
                for column, value in zip(rows, (segment, i, len(words), held, [counts[t] for t in held]), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["segment", "id", "n", "terms", "tf"])

    return docs.select(quoted(id_col).cast("bigint").alias("id"), utf8(text).alias("text")).mapInArrow(run, schema)


def corpus_of(rows: DataFrame, vocabulary: dict[bytes, int]) -> Corpus:
    """Counted over all documents; document frequencies are at most as many as the vocabulary has terms."""
    documents, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r.term] = r["count"]
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()]
    return Corpus(documents, tokens, np.array(weights, np.int64))


def impacts(rows: pa.Table | pa.RecordBatch, corpus: Corpus) -> Csr:
    """Documents by terms: weight * ((1000000000 * tf) div (1000 * tf + 12 * m))."""

    def whole(name):
        c = rows.column(name)
        return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    lists = whole("terms")
    each = lists.value_lengths().to_numpy().astype(np.int64)
    terms, tf = (whole(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
    m = 75 + (25 * whole("n").to_numpy() * corpus.documents) // corpus.tokens
    value = corpus.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, each)))
    return Csr(np.concatenate(([0], each.cumsum())), terms, value)


def taken(docs: Csr, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some rows, one after the other: the place in rows of each, and its place in the matrix."""
    each = docs.starts[rows + 1] - docs.starts[rows]
    owner = np.repeat(np.arange(len(rows)), each)
    return owner, np.arange(len(owner)) + np.repeat(docs.starts[rows] - (each.cumsum() - each), each)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores above 0, equal ones by ascending id."""
    order = np.lexsort((ids, -scores))[:k]
    return order[scores[order] > 0]


def matrix_of(items: Items) -> Csr:
    """Terms by items: how often an item has a term."""
    item = np.repeat(np.arange(len(items.ids)), np.diff(items.starts))
    order = np.argsort(items.terms, kind="stable")
    return Csr(np.searchsorted(items.terms[order], np.arange(len(items.vocabulary) + 1)), item[order], items.times[order])


def thresholds(rows: DataFrame, items: Items, corpus: Corpus, k: int, docs: int = SEED_DOCS) -> np.ndarray:
    """For each item a score that at least k documents reach, from a sample: the k-th largest in it, or 1 where it has fewer.
    They only save work: no document below one can be a result."""
    sample = rows.sample(min(1.0, docs / max(1, corpus.documents)), seed=42) if corpus.documents > docs else rows
    sent = rows.sparkSession.sparkContext.broadcast((items, corpus))

    def run(batches):
        items, corpus = sent.value
        by_term = matrix_of(items)
        best: list[np.ndarray] = [np.empty(0, np.int64)] * len(items.ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                scores = product(impacts(batch.slice(at, 256), corpus), by_term, len(items.ids))
                order = np.argsort(scores.indices, kind="stable")
                values, cut = scores.values[order], np.searchsorted(scores.indices[order], np.arange(len(items.ids) + 1))
                for i in np.unique(scores.indices).tolist():
                    best[i] = np.sort(np.concatenate((best[i], values[cut[i] : cut[i + 1]])))[-k:]
        item = np.repeat(np.arange(len(best)), [len(b) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.concatenate([*best, np.empty(0, np.int64)]), pa.int64())], names=["item", "score"])

    found = sample.where("size(terms) > 0").mapInArrow(run, "item int, score bigint").where("score > 0")
    ranked = found.selectExpr("item", "score", "row_number() over (partition by item order by score desc) as rank").where(F.col("rank") <= k)
    floor = np.ones(len(items.ids), np.int64)
    for r in ranked.groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).collect():  # a row an item
        floor[r.item] = r.score
    return floor


def needed_lists(docs: Csr, items: Items, floor: np.ndarray) -> list[np.ndarray]:
    """For each item the places of its terms whose lists must be opened, by falling bound: documents that have none of
    these terms stay below the item's threshold, as the largest impacts of the others together do."""
    most = np.zeros(len(items.vocabulary), np.int64)
    np.maximum.at(most, docs.indices, docs.values)
    found = []
    for i in range(len(items.ids)):
        terms, times = items.of(i)
        bound = times * most[terms]
        order = np.argsort(bound, kind="stable")
        closed = np.searchsorted(bound[order].cumsum(), floor[i])
        found.append(order[closed:][::-1])
    return found


def clusters(points: np.ndarray, size: int) -> np.ndarray:
    """A block number for each point: each goes to the most similar of some of them, and large clusters are cut."""
    k = -(-len(points) // size)
    if k == 1:
        return np.zeros(len(points), np.int64)
    pivots = points[np.linspace(0, len(points) - 1, k).astype(np.int64)]
    nearest = np.concatenate([np.argmax(points[at : at + 4096] @ pivots.T, axis=1) for at in range(0, len(points), 4096)])
    order = np.argsort(nearest, kind="stable")
    first = np.searchsorted(nearest[order], nearest[order])
    part = nearest[order] * len(points) + (np.arange(len(points)) - first) // size
    block = np.empty(len(points), np.int64)
    block[order] = np.cumsum(np.diff(part, prepend=part[0]) > 0)
    return block


def sketches(docs: Csr, terms: int) -> np.ndarray:
    """A short vector for each document whose inner products follow those of the impacts, and whose length is 1."""
    signs = np.random.default_rng(42).choice(np.array([-1, 1], np.float32), (terms, DIMENSIONS))
    points = np.zeros((len(docs.starts) - 1, DIMENSIONS), np.float32)
    for at in range(0, len(points), 512):
        own = slice(docs.starts[at], docs.starts[min(at + 512, len(points))])
        row = np.repeat(np.arange(min(512, len(points) - at)), np.diff(docs.starts[at : at + 513]))
        for d in range(DIMENSIONS):
            points[at : at + 512, d] = np.bincount(row, docs.values[own] * signs[docs.indices[own], d], min(512, len(points) - at))
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-30)


#: A row a block: its documents (places in the segment), and the largest impact in them of each term that a query may ask of it.
INDEX = "segment bigint, term int, block int, members array<int>, terms array<int>, largest array<bigint>"


def block_lists(docs: Csr, items: Items, floor: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """term, block, members, terms and largest impacts of all blocks that some item may need."""
    needed = needed_lists(docs, items, floor)
    askers: dict[int, list[int]] = {}
    for i, places in enumerate(needed):
        for t in items.of(i)[0][places].tolist():
            askers.setdefault(t, []).append(i)
    order = np.argsort(docs.indices, kind="stable")
    row = np.repeat(np.arange(len(docs.starts) - 1), np.diff(docs.starts))[order]
    cut = np.searchsorted(docs.indices[order], np.arange(len(items.vocabulary) + 1))
    points = sketches(docs, len(items.vocabulary)) if askers else np.empty((0, DIMENSIONS))
    asked = np.full(len(items.vocabulary), -1, np.int64)
    for t in sorted(askers):
        members = row[cut[t] : cut[t + 1]]
        if not len(members):
            continue
        columns = np.unique(np.concatenate([items.of(i)[0] for i in askers[t]]))
        asked[columns] = np.arange(len(columns))
        block = clusters(points[members], BLOCK)
        order_ = np.argsort(block, kind="stable")
        members, block = members[order_], block[order_]
        n = int(block[-1]) + 1
        at = np.searchsorted(block, np.arange(n + 1))
        step = max(1, 2_000_000 // len(columns))  # blocks whose summaries are made at once
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            own = members[at[lo] : at[hi]]
            owner, entry = taken(docs, own)
            column = asked[docs.indices[entry]]
            kept = column >= 0
            summary = np.zeros((hi - lo, len(columns)), np.int64)
            np.maximum.at(summary.reshape(-1), (block[at[lo] : at[hi]][owner] - lo)[kept] * len(columns) + column[kept], docs.values[entry][kept])
            for b in range(lo, hi):
                held = np.flatnonzero(summary[b - lo])
                yield t, b, members[at[b] : at[b + 1]], columns[held], summary[b - lo][held]
        asked[columns] = -1


class Found(NamedTuple):
    item: np.ndarray
    row: np.ndarray
    score: np.ndarray
    blocks: int
    opened: int


def search_segment(docs: Csr, ids: np.ndarray, index: dict[int, tuple[Csr, Csr]], items: Items, floor: np.ndarray, k: int) -> Found:
    """The k best documents of a segment for each item, of those that reach its threshold.

    index: term -> (blocks by documents, blocks by terms with the largest impacts).
    """
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    blocks = opened = 0
    wanted = np.zeros(len(items.vocabulary), np.int64)
    for i, places in enumerate(needed_lists(docs, items, floor)):
        terms, times = items.of(i)
        wanted[terms] = times
        seen = np.zeros(len(ids), bool)
        rows, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), int(floor[i])
        for t in terms[places].tolist():
            if t not in index:
                continue
            lists, summaries = index[t]
            bound = np.diff(np.concatenate(([0], (summaries.values * wanted[summaries.indices]).cumsum()))[summaries.starts])
            open_ = np.flatnonzero(bound >= least)
            blocks, opened = blocks + len(bound), opened + len(open_)
            new = lists.indices[taken(lists, open_)[1]]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            _, entry = taken(docs, new)
            each = docs.starts[new + 1] - docs.starts[new]
            got = np.diff(np.concatenate(([0], (docs.values[entry] * wanted[docs.indices[entry]]).cumsum()))[np.concatenate(([0], each.cumsum()))])
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, got))
            best = best_rows(scores, ids[rows], k)
            rows, scores = rows[best], scores[best]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
        wanted[terms] = 0
        reached = scores >= floor[i]
        found.append((i, rows[reached], scores[reached]))
    item = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
    return Found(item, *(np.concatenate([f[j] for f in found] or [np.empty(0, np.int64)]) for j in (1, 2)), blocks, opened)


def index_of(rows: pa.Table) -> dict[int, tuple[Csr, Csr]]:
    """The stored blocks of a segment, by term."""
    rows = rows.sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
    term = rows.column("term").to_numpy()
    columns = []
    for name in ("members", "terms"):
        lists = rows.column(name).combine_chunks()
        columns.append((np.concatenate(([0], lists.value_lengths().to_numpy().astype(np.int64).cumsum())), lists.flatten().to_numpy().astype(np.int64)))
    largest = rows.column("largest").combine_chunks().flatten().to_numpy()
    found = {}
    values, first = np.unique(term, return_index=True)
    for t, lo, hi in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(term)]):
        (m, members), (s, terms) = ((starts[lo : hi + 1] - starts[lo], held[starts[lo] : starts[hi]]) for starts, held in columns)
        found[t] = Csr(m, members, members), Csr(s, terms, largest[columns[1][0][lo] : columns[1][0][hi]])
    return found


def search_block(rows: DataFrame, items: Items, k: int) -> DataFrame:
    """item (place in the block), id and score of each item's k best documents, with rank."""
    context = rows.sparkSession.sparkContext
    corpus = corpus_of(rows, items.vocabulary)
    floor = thresholds(rows, items, corpus, k)
    sent = context.broadcast((items, corpus, floor))
    held = rows.where("size(terms) > 0")

    def build(own: pa.Table) -> pa.Table:
        items, corpus, floor = sent.value
        own = own.sort_by([("id", "ascending"), ("n", "ascending")])
        blocks = list(block_lists(impacts(own, corpus), items, floor))
        segment = own.column("segment")[0].as_py() if own.num_rows else None
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns = [pa.array(c, t) for c, t in zip(zip(*blocks) if blocks else [[]] * 5, kinds, strict=True)]
        return pa.table([pa.array([segment] * len(blocks), pa.int64()), *columns], names=["segment", "term", "block", "members", "terms", "largest"])

    def search(own: pa.Table, blocks: pa.Table) -> pa.Table:
        items, corpus, floor = sent.value
        own = own.sort_by([("id", "ascending"), ("n", "ascending")])
        order = own.column("id").fill_null(HIGHEST).to_numpy()
        found = search_segment(impacts(own, corpus), order, index_of(blocks), items, floor, k)
        return pa.table([pa.array(found.item, pa.int32()), own.column("id").take(pa.array(found.row)).combine_chunks(), pa.array(found.score)], names=["item", "id", "score"])

    index = stored(held.groupBy("segment").applyInArrow(build, INDEX), "lists", compression="zstd")
    found = held.groupBy("segment").cogroup(index.groupBy("segment")).applyInArrow(search, "item int, id bigint, score bigint")
    rank = "row_number() over (partition by item order by score desc, id asc nulls last)"
    found = stored(found.selectExpr("*", f"{rank} as rank").where(F.col("rank") <= k), "found")
    discard(rows.sparkSession, index)
    return found


def search_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id and score: the k documents of largest score above 0 for each row of items, equal scores by ascending id.

    The id is a whole number; documents with a null id come last among equal scores. A null or empty text has no terms: such a document is
    not counted and such an item finds nothing. Repeated rows are documents, or items, of their own. Texts are read whole. Empty
    tables give an empty result. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in items.schema}
    result = None
    for block in item_blocks(items, item_id, item_text):
        rows = stored(forward_rows(docs, block.vocabulary, id_col, text), "documents", compression="zstd")
        found = search_block(rows, block, k)
        discard(spark, rows)
        names = spark.createDataFrame(list(enumerate(block.ids)), StructType([StructField("item", found.schema["item"].dataType), StructField("item_id", kinds[item_id])]))
        named = found.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        result = named if result is None else result.unionByName(named)
    if result is None:
        result = spark.createDataFrame([], StructType([StructField(item_id, kinds[item_id]), StructField("rank", IntegerType()), StructField(id_col, LongType()), StructField("score", LongType())]))
    return result


def query(spark, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with words as (
  select 0 as kind, doc_id as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
  union all
  select 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) from benchmark),
 held as (select kind, id, term, count(*) as tf from words group by all),
 lengths as (select id, sum(tf)::bigint as n from held where kind = 0 group by id),
 totals as (select count(*) as docs, sum(n)::bigint as tokens from lengths),
 weights as (select term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from held, totals where kind = 0 group by term),
 scores as (
  select q.id as item_id, d.id as doc_id, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * docs) // tokens))))::bigint as score
  from held q join held d on q.kind = 1 and d.kind = 0 and q.term = d.term join weights on weights.term = q.term join lengths on lengths.id = d.id, totals
  group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0
qualify rank <= 20
"""
