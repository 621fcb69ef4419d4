"""Token counts, packing, mixing, sharding and near-duplicates against brute force, on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideguard.llm import best_fit, histogram_sort, poisson_mix, simhash, token_counts
from tideguard.llm.common import new_path

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [" ", "  ", "a", "the", "'s", " ing", "\n", "\t", "▁", "é", "日", "<s>", "</s>", "<|endoftext|>", "　", "\xa0", "\r", ";", "x1", "\x00", "😀", ".", ","]


def texts(n, seed=1, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def test_token_lengths_equal_whole_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lengths = token_counts.Lengths(PIECES, {})
    for t in texts(5000):
        assert lengths.count(t) == len(model.encode(t)), repr(t)


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 5)
    lengths = token_counts.Lengths(PIECES, {"the": 1})
    assert [lengths.count(f"w{i} the w{i}") for i in range(20)] == [len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(f"w{i} the w{i}")) for i in range(20)]
    assert len(lengths) <= 6 and lengths["the"] == 1


def test_count_tokens(odd, odd_rows, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(clash(odd, "N_Tokens"), PIECES, limit=100, keep=None)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r[0], r[1], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 100) for r in odd_rows)
    assert Counter((r.doc_id, r.text, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_json_tokenizer_counts(odd, odd_rows):
    model = Tokenizer.from_file(BPE)
    got = token_counts.count_tokens(odd, BPE, keep=["doc_id"])
    want = Counter((r[0], len(model.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want


@pytest.mark.parametrize("path", [BPE, public_tokenizers.path("word_bpe_49k.json")])
def test_ids_equal_whole_texts(path):
    model, ids = Tokenizer.from_file(path), best_fit.Ids(path)
    for t in texts(4000, 2):
        assert np.frombuffer(ids.of(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("per_task", [200_000, 6])
def test_packing(odd, odd_rows, per_task):
    model = Tokenizer.from_file(BPE)
    got = best_fit.pack_documents(clash(odd, "piece", "bin"), BPE, capacity=512, keep=["doc_id"], pieces_per_task=per_task).collect()
    want = Counter()
    total = 0
    for r in odd_rows:
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        cut, at, k = len(ids) % 512 or 512, 0, 0
        while at < len(ids):
            part = ids[at:cut]
            want[(r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
            at, cut, k = cut, cut + 512, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    half_empty = sum(2 * sum(n for _, n in parts) <= 512 for parts in sequences.values())
    assert half_empty <= 1  # the tree has merged what the tasks left
    assert len(sequences) <= 1.25 * -(-total // 512)


def test_packing_nothing(empty):
    assert best_fit.pack_documents(empty, BPE, keep=["doc_id"]).count() == 0


def test_best_fit_is_best_fit():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(60)), reverse=True)
        bins: list[int] = []
        want = []
        for s in sizes:
            fits = [(100 - b, i) for i, b in enumerate(bins) if b + s <= 100]
            i = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append(0)
            want.append((i, bins[i]))
            bins[i] += s
        assert [o for _, o in best_fit.best_fit(sizes, 100)] == [o for _, o in want]
        assert len({b for b, _ in best_fit.best_fit(sizes, 100)}) == len(bins)


def sharded(df, **options):
    return histogram_sort.shard_documents(df, **options).collect()


def test_chunks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, '', repeat(concat('t', id), 200)) as text")
    found = []
    mapped = type(df).mapInArrow

    def kept(self, *args):
        found.append(mapped(self, *args))
        return found[-1]

    monkeypatch.setattr(type(df), "mapInArrow", kept)
    rows = sharded(df, shards=2, rows_per_chunk=100)
    monkeypatch.undo()
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = [r["count"] for r in found[-1].groupBy("__chunk").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 150



def check_shards(rows, docs, shards, slack):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    slots = defaultdict(list)
    sizes = Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max((r.size for r in rows), default=0)
    assert all(abs(sizes[s] - total / shards) <= slack * total / shards + 2 * largest for s in range(shards))


def test_shards_of_odd_rows(odd, odd_rows, empty):
    rows = sharded(clash(odd, "Shard", "size"), shards=4, keep=["doc_id"])
    check_shards(rows, [(r[0], r[1]) for r in odd_rows], 4, 0.01)
    assert sharded(empty) == []


@pytest.mark.parametrize("chunk", [500_000, 100])
def test_shards_split_hot_texts_only(spark, chunk):
    docs = [(i, f"text {i % 700} " * 3) for i in range(2000)] + [(i, "hot " * 6) for i in range(2000, 3200)] + [(7, "same row " * 3)] * 600
    rows = sharded(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), shards=16, keep=["doc_id"], rows_per_chunk=chunk)
    check_shards(rows, docs, 16, 0.01)
    at = defaultdict(set)
    for r in rows:
        at[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in at.values()) <= 15  # a boundary cuts one group at most


def brute_simhash(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [b" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, bits):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (int(points[i]) ^ int(points[j])).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def planted(rng, n=300, chains=12):
    """Random fingerprints, chains of small steps, and a dense ball."""
    points = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(chains):
        x = rng.choice(points[:n])
        for _ in range(rng.randint(1, 25)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            points.append(x)
    centre = rng.getrandbits(64)
    points += [centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(200)]
    return sorted(set(points))


@pytest.mark.parametrize("leaf", [2048, 16])
def test_components(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(5)
    for bits in (0, 1, 3, 5):
        points = planted(rng)
        got = simhash.components(np.array(points, np.uint64), bits)
        assert got.tolist() == brute_components(points, bits)


def test_dense_and_split_shards(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    rng = random.Random(6)
    low = [x & 0xFFFFFFFFFFFF0000 | 7 for x in planted(rng)]
    points = sorted(set(low))
    fp = np.sort(np.array(points, np.uint64).view(np.int64))
    a, b = simhash.stars(np.zeros(len(fp), np.int64), fp, 3)
    roots = simhash.joined(len(fp), np.searchsorted(fp, a), np.searchsorted(fp, b))
    assert roots.tolist() == brute_components(fp.view(np.uint64).tolist(), 3)
    assert len(a) == len(fp) - len(set(roots.tolist()))  # a star each, not all pairs


@pytest.mark.parametrize("shard", [200_000, 20])
def test_links_of_shards(spark, shard):
    points = planted(random.Random(7))
    points = sorted(set(points + [x & ~0xFFFF for x in points[:150]]))
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 3, shard).collect()
    where = {x: i for i, x in enumerate(signed)}
    roots = simhash.joined(len(points), np.array([where[r.a] for r in edges]), np.array([where[r.b] for r in edges]))
    assert roots.tolist() == brute_components(points, 3)


def test_connected(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_duplicates(odd, odd_rows, empty):
    got = simhash.near_duplicates(clash(odd, "FP", "component_id"), keep=["doc_id"]).collect()
    points = sorted({brute_simhash(r[1]) for r in odd_rows})
    roots = dict(zip(points, brute_components(points, 3), strict=True))
    least = {}
    for r in odd_rows:
        if r[0] is not None:
            k = roots[brute_simhash(r[1])]
            least[k] = min(least.get(k, r[0]), r[0])
    want = Counter((r[0], brute_simhash(r[1]), least.get(roots[brute_simhash(r[1])])) for r in odd_rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(odd, odd_rows, empty):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    groups = {}
    for r in simhash.near_duplicates(odd, keep=["doc_id"]).collect():
        groups.setdefault(r.component_id, 0)
    assert len(rows) == len(groups)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(k for k in groups if k is not None)
    assert simhash.keep_one(empty).count() == 0


def test_fingerprints_of_texts():
    for t in [*texts(200, 9, 40), "A b C d E", "ÀÉ À é"]:
        assert simhash.fingerprint(t.encode()) == brute_simhash(t)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.execute(sql).fetchall()


def test_mixing_equals_sql(odd):
    docs = odd.where("doc_id is not null")
    got = poisson_mix.mix_sources(docs, keep=["doc_id", "source"])
    want = duck(poisson_mix.ORACLE_SQL, documents=docs)
    key = lambda r: (r[0], r[1] or "", r[3], r[4], r[5])
    assert Counter(key((r.doc_id, r.source, r.rate, r.copies, r.copy, r.shuffle_key)) for r in got.collect()) == Counter(map(key, want))


@pytest.mark.parametrize("limit", [4096, 1])
def test_mixing_meets_weights(spark, monkeypatch, limit):
    monkeypatch.setattr(poisson_mix, "BROADCAST_SOURCES", limit)
    docs = spark.createDataFrame([(i, "x" * 10, "big" if i % 10 else "small") for i in range(6000)], "doc_id bigint, text string, source string")
    got = poisson_mix.mix_sources(docs, weights={"big": 1.0, "small": 1.0})
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["big"] - 3000) < 250 and abs(counts["small"] - 3000) < 250
    keys = [r.shuffle_key for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert poisson_mix.mix_sources(docs, weights={"big": 0.0}).count() == 0
    large = poisson_mix.mix_sources(docs.where("doc_id < 20"), epochs=80.0).groupBy("doc_id").count().collect()
    assert abs(sum(r["count"] for r in large) - 1600) < 200


def test_mixing_odd_rows(odd, empty):
    got = poisson_mix.mix_sources(clash(odd, "Copies", "copy", "rate"), epochs=3.0)
    assert got.columns == [*odd.columns, "rate", "copies", "copy", "shuffle_key"]
    unnamed = got.where("doc_id is null")
    assert unnamed.select("shuffle_key").distinct().count() == unnamed.count()
    assert poisson_mix.mix_sources(empty).count() == 0


def test_vantage_tree_prunes_and_keeps_pairs(spark):
    rng = random.Random(10)
    points = sorted({rng.getrandbits(64) for _ in range(6000)} | set(planted(rng)))
    fps = spark.createDataFrame([(x,) for x in np.array(points, np.uint64).view(np.int64).tolist()], "fp bigint")
    tree, leaves = simhash.vantage_tree(fps, 3)
    assert isinstance(tree, tuple) and leaves >= 4
    array, pruned, homes = np.array(points, np.uint64), [], defaultdict(set)
    for at, leaf in simhash.descend(tree, array, np.arange(len(array)), 3, pruned):
        for i in at.tolist():
            homes[i].add(leaf)
    assert len(homes) == len(points) and sum(map(len, homes.values())) < leaves * len(points) / 2 and sum(pruned) > 0
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3) + i + 1:
            assert homes[i] & homes[int(j)]  # a pair meets in some leaf
    edges = simhash.links(fps, 3).collect()
    where = {x: i for i, x in enumerate(array.view(np.int64).tolist())}
    roots = simhash.joined(len(points), np.array([where[r.a] for r in edges]), np.array([where[r.b] for r in edges]))
    assert roots.tolist() == brute_components_fast(array, 3)


def brute_components_fast(array, bits):
    a, b = [], []
    for i in range(len(array)):
        hit = np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits) + i + 1
        a += [i] * len(hit)
        b += hit.tolist()
    roots = list(range(len(array)))
    for _ in range(len(array)):
        before = list(roots)
        for i, j in zip(a, b):
            roots[i] = roots[j] = min(roots[i], roots[j])
        if roots == before:
            return roots


def test_keep_one_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, "x", 5), (2, "a b c d", 8, "y", 6), (3, "quite another text", 9, None, None)], "doc_id bigint, text string, fp int, __id string, c0 int").withColumn("__row", F.lit(0))
    rows = sorted(map(tuple, simhash.keep_one(docs).collect()))
    assert rows == [(1, "a b c d", 7, "x", 5, 0), (3, "quite another text", 9, None, None, 0)]
    got = simhash.near_duplicates(docs, keep=["__id", "c0"])
    assert got.columns == ["__id", "c0", "fp", "component_id"] and Counter(r.component_id for r in got.collect()) == {1: 2, 3: 1}


def test_hot_keys_of_a_join_are_not_shuffled(spark):
    from tideguard.llm.common import spread_join

    rows = spark.createDataFrame([(i, 5 if i % 2 else 10_000 + i) for i in range(4000)], "i int, k int")
    keyed = rows.groupBy("k").agg(F.max("i").alias("m"))
    got = spread_join(rows, keyed, "k")
    assert Counter((r.i, r.k, r.m) for r in got.collect()) == Counter((r.i, r.k, r.m) for r in rows.join(keyed, "k").collect())
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_rows_without_an_id_draw_independently(spark):
    rows = [(None, "same text", "a")] * 1500 + [(None, f"text {i}", "a") for i in range(1500)] + [(i, "named", "a") for i in range(1000)]
    path = str(new_path(spark, "no-ids"))
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    for seed in (1, 2, 3, 4):
        got = poisson_mix.mix_sources(docs, seed=seed).collect()
        for same in (True, False):
            mine = [r for r in got if r.doc_id is None and (r.text == "same text") == same]
            assert 1500 - 200 < len(mine) < 1500 + 200  # five deviations
            draws = Counter(r.copies for r in mine if r.copy == 1)
            assert {1, 2, 3} <= set(draws) and 1500 * 0.31 < draws[1] < 1500 * 0.43
        assert len({r.shuffle_key for r in got}) == len(got)
        assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_mixing_draws_once(odd):
    plan = poisson_mix.mix_sources(odd)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Python" not in plan and "Arrow" not in plan


def test_frequent_parts_are_not_shuffled_by_key(spark, monkeypatch):
    """Summaries of tasks are merged as rows; the table holds just the parts of the needed share."""
    monkeypatch.setattr(token_counts, "SAMPLE_ONE_IN", 1)
    monkeypatch.setattr(token_counts, "FAN_IN", 2)
    monkeypatch.setattr(token_counts, "FREQUENT", 20)
    texts_ = ["the cat and the dog"] * 30 + [f"rare{i} the" for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts_], "text string").repartition(7)
    calls = []
    monkeypatch.setattr(type(docs), "groupBy", lambda *a, **k: calls.append(a))
    words, lengths = token_counts.frequent_lengths(docs, "text", PIECES)
    monkeypatch.undo()
    counts = Counter(w for t in texts_ for w in t.split(" "))
    total = sum(counts.values())
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert not calls and words.split("\n") == sorted(w for w, n in counts.items() if n * 20 >= total)
    assert list(lengths) == [len(model.encode(w)) for w in words.split("\n")]


def test_packing_keeps_columns_of_any_name(odd):
    names = ["bin", "into", "base", "c0", "task", "__text"]
    got = best_fit.pack_documents(odd.select("doc_id", "text", *[F.lit(n).alias(n) for n in names]), BPE, capacity=512, pieces_per_task=6)
    assert got.columns == ["doc_id", "text", *names, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert all([r[n] for n in names] == names for r in got.collect())
