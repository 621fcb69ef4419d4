"""Token alignment, lexical search and URL filters against brute force; columns of any name; Poisson counts of any rate."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideguard.functions import bloom
from tideguard.llm import best_fit, histogram_sort, html_text, jpeg, lexical_search, line_crf, poisson_mix, simhash, token_align, token_counts, toxicity, url_filter

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- token alignment ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def alone():
    """The alignment of one text by loops: columns, and how many links each id pair has."""
    a_model, b_model = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def of_piece(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def align(text):
        nothing = (0, 0, 0, 0, 0, "", Counter())
        if not text:
            return nothing
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        data = [[bytes(byte[c] for c in a_model.id_to_token(i)) for i in a], [of_piece(i) for i in b]]
        if not all(b"".join(x) == (" " + text).encode() for x in data):
            return nothing
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in data]
        starts = [[0, *e[:-1]] for e in ends]
        links = Counter((a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i])
        groups, low, shared = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ([str(t) for t, f in zip(ids, side) if low < f <= e] for ids, side in zip((a, b), ends))
            groups.append(",".join(x) + "|" + ",".join(y))
            low, shared = e, shared + len(x) * len(y)
        return len(a), len(b), len(groups), sum(links.values()), shared, hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    return align


PARTS = [" ", "  ", "a", "the", "'s", " ing", "\n", "\t", "▁", "é", "日本", "<s>", "</s>", "<|endoftext|>", "　", "\xa0", "\r", ";", "x1", "\x00", "😀", ".", ",", " word", "\x1c", "\x85"]


def test_alignment_equals_loops(alone, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["", "x" * 3000, "word " * 50 + "▁" + " word" * 50]
    for at_once, cache in ((32_000, 250_000), (40, 20)):
        monkeypatch.setattr(token_align, "AT_ONCE", at_once)
        monkeypatch.setattr(token_align, "CACHE", cache)
        aligner = token_align.Aligner(BPE, PIECES)
        for at in range(0, len(texts), 100):
            for text, got in zip(texts[at : at + 100], token_align.aligned(aligner, texts[at : at + 100])):
                *columns, links = alone(text)
                assert got[:6] == tuple(columns), repr(text)
                assert dict(zip(got[6].tolist(), got[7].tolist())) == {(a << 32) + b: n for (a, b), n in links.items()}
    assert sum(alone(t)[0] > 0 for t in texts) > 500


def dense(m, width):
    out = np.zeros((len(m.starts) - 1, width), np.int64)
    for i in range(len(out)):
        np.add.at(out[i], m.indices[m.starts[i] : m.starts[i + 1]], m.values[m.starts[i] : m.starts[i + 1]])
    return out


def test_products_of_sparse_rows():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, m, k = rng.integers(1, 9, 3)
        a, b = (rng.integers(-2, 3, s) * (rng.random(s) < 0.5) for s in ((n, m), (m, k)))

        def sparse(x):
            rows, columns = np.nonzero(x)
            return token_align.Csr(np.searchsorted(rows, np.arange(len(x) + 1)), columns, x[rows, columns])

        assert (dense(token_align.product(sparse(a), sparse(b), int(k)), k) == a @ b).all()
    empty = token_align.Csr(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    assert len(token_align.product(empty, empty, 0).indices) == 0


def test_links_of_one_group():
    group_a, group_b = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 1, 2, 2])
    want = [(i, j) for i in range(5) for j in range(6) if group_a[i] == group_b[j]]
    for rows in (1, 2, 100):
        assert list(token_align.shared_links(group_a, group_b, rows)) == want
    assert list(token_align.shared_links(np.empty(0, np.int64), np.empty(0, np.int64))) == []


@pytest.mark.parametrize("frequent", [1 << 19, 50, 0])
def test_alignment_of_odd_rows(odd, odd_rows, empty, alone, frequent):
    """Counts are of rows that hold a pair; they are the same whether a pair is looked up or joined."""
    from tideguard.llm.token_align import align_tokens

    found = [alone(r[1]) if len(r[1] or "") < 5000 else None for r in odd_rows]
    rows = odd.where("text is null or length(text) < 5000")
    found = [x for x in found if x]
    held = Counter(p for x in found for p in x[6])
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    ids = [r[0] for r in odd_rows if len(r[1] or "") < 5000]
    want = Counter((i, *x[:6], sum(n for p, n in x[6].items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in x[6].items())) for i, x in zip(ids, found))
    got = align_tokens(rows, BPE, PIECES, keep=["doc_id"], frequent=frequent)
    assert Counter(map(tuple, got.collect())) == want
    assert align_tokens(empty, BPE, PIECES, frequent=frequent).count() == 0


# --- lexical search ----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, tokens = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        asked, scores = Counter(plain_terms(text)), []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // tokens
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        found += [(item, rank, i, s) for rank, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(found, key=repr)


def test_terms():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "B", "É", "é", "日", " ", "\t", "-", "_", "9", "\x00", "[", "~", "\x7f", "\x80", "😀", "Z"]) for _ in range(rng.randint(0, 9)))
        assert [t.decode() for t in lexical_search.terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("segment, block, seed, at_once", [(4096, 8, 16_384, 1024), (7, 2, 16_384, 2), (50, 4, 40, 1024), (4096, 1, 0, 1)])
def test_search_equals_all_scores(spark, monkeypatch, segment, block, seed, at_once):
    """Ties, repeated documents and items, nulls, unknown and repeated terms; whatever the sizes of segments, blocks and samples."""
    rng = random.Random(segment)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w50, w51 W52!") for i in range(40)] + [(7, "w59 w59 w59"), (7, "w59 w59 w59"), (None, "w59 w58"), (400, None), (401, ""), (402, "w3 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(8)] + [(20, "w59 w59 w1"), (20, "w59 w59 w1"), (21, None), (22, "nowhere"), (None, "W50-w51"), (23, "w0")]
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "SEED_DOCS", seed)
    monkeypatch.setattr(lexical_search, "ITEMS_AT_ONCE", at_once)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("segment", F.lit("clash")).repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit("clash"))
    got = sorted((tuple(r) for r in lexical_search.search_documents(d, q).collect()), key=repr)
    assert got == plain_search(docs, items)
    assert lexical_search.search_documents(d.limit(0), q).count() == 0 and lexical_search.search_documents(d, q.limit(0)).count() == 0


def test_blocks_bound_their_documents_and_are_skipped():
    """A summary's product with an item is at least any document's score; alike documents share blocks, so blocks stay closed."""
    rng = np.random.default_rng(5)
    topics = [rng.choice(200, 30, replace=False) for _ in range(10)]
    rows = []
    for d in range(800):
        terms = np.unique(np.concatenate((rng.choice(topics[d % 10], 12), rng.choice(200, 2))))
        rows.append((terms, rng.integers(1, 50, len(terms))))
    starts = np.cumsum([0, *[len(t) for t, _ in rows]])
    docs = token_align.Csr(starts, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.int64))
    wanted = [np.unique(rng.choice(topics[i], 8)) for i in range(10)]
    cut = np.cumsum([0, *map(len, wanted)])
    items = lexical_search.Items(list(range(10)), {str(i).encode(): i for i in range(200)}, cut, np.concatenate(wanted), np.ones(cut[-1], np.int64))
    exact = np.zeros((10, 800), np.int64)
    for i, terms in enumerate(wanted):
        for d, (t, v) in enumerate(rows):
            exact[i, d] = v[np.isin(t, terms)].sum()
    floor = np.sort(exact, axis=1)[:, -20]
    blocks = list(lexical_search.block_lists(docs, items, floor))
    needed = [set(wanted[i][places]) for i, places in enumerate(lexical_search.needed_lists(docs, items, floor))]
    for term, _, members, terms, largest in blocks:
        for i in range(10):
            if term in needed[i]:
                assert largest[np.isin(terms, wanted[i])].sum() >= exact[i, members].max()
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    stored = pa.table([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names=["term", "block", "members", "terms", "largest"])
    found = lexical_search.search_segment(docs, np.arange(800), lexical_search.index_of(stored), items, floor, 20)
    for i in range(10):
        want = sorted(range(800), key=lambda d: (-exact[i, d], d))[:20]
        assert found.row[found.item == i].tolist() == want and found.score[found.item == i].tolist() == exact[i, want].tolist()
    assert found.opened < 0.8 * found.blocks


# --- URL filters -------------------------------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path, rules):
    fits = [(len(h + p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.ORG", "http://a.org/", "http://a.org?x=/", "http://org/", "http://a.orgs/", "http://example.org/es/1", "http://x.example.org/en/12#a",
    "http://example.org/en/2", "http://M.com/fr/", "http://www.com/de/x", "http://com/de", "http://com.net/de/", "a://b://c/d", "http://É.ORG/é\nx", "http://user@h.com:80/fr/1?a#b", "http://h.net/\n/de/",
    "http://www.spam.net/a/?b=2&a=1&utm_source=x#t", "https://spam.net/a/index.html?a=1&b=2", "http://spam.net/a?b=2", "http://m.spam.net:443/c.html", "http://spam.net/c/",
]


def test_url_parts_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)] + [(3, "http://a.org/"), (None, "http://a.org/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = url_filter.judge_urls(pages, pages.limit(0)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = plain_parts(r.url)
        verdict, rule = plain_rule(host, path, url_filter.RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url
    tie = [("allow", "b.c", "/"), ("block", "c", "/bb"), ("allow", "c", "/b")]
    got = url_filter.judge_urls(spark.createDataFrame([("x://a.b.c/bb",), ("x://b.c/b",)], "url string"), pages.limit(0), rules=tie).collect()
    assert {r.url: (r.rule, r.verdict) for r in got} == {"x://a.b.c/bb": ("c/bb", "block"), "x://b.c/b": ("b.c/", "allow")}


@pytest.mark.parametrize("most", [1 << 18, 1])
def test_listed_urls_are_blocked(spark, monkeypatch, most):
    """Equal canonical forms only, even from a filter so full that most URLs pass it; a hot URL is one of many."""
    monkeypatch.setattr(bloom, "MOST_BLOCKS", most)
    listed = spark.createDataFrame([(f"https://www.h{i}.net/p/{i}/?utm_campaign=a&z=1&b={i}#x",) for i in range(300)] + [(None,), ("none",)], "link string")
    rows = [(i, f"http://m.h{i % 600}.net:80/p/{i % 600}.html?b={i % 600}&z=1", "x") for i in range(1200)] + [(i, "http://h5.net/p/5?z=1&b=5", "x") for i in range(1200, 2000)]
    pages = spark.createDataFrame(rows + [(1, None, "x")], "page_id bigint, url string, entry string").withColumns({c: F.lit("clash") for c in ("Host", "block", "w0", "found", "__salt")})
    got = url_filter.judge_urls(pages, listed, rules=[], listed_url="link")
    assert got.columns == ["page_id", "url", "entry", "block", "w0", "found", "__salt", "host", "path", "rule", "verdict"]
    found = got.collect()
    assert len(found) == 2001 and {r.entry for r in found} == {"x"}
    assert all(r.verdict == ("block" if r.url and (r.page_id >= 1200 or r.page_id % 600 < 300) else "allow") and r.rule is None for r in found)


# --- names, and draws ---------------------------------------------------------------------------------------------------

NAMES = [
    "__in0", "in0", "out0", "c0", "c1", "h0", "__k1", "__k2", "__k3", "__chunk", "__before", "__id", "__source", "__rate", "__salt", "__bytes", "__weight", "row", "pairs", "times", "segment", "terms", "tf", "item", "id", "n",
    "data", "y", "fp", "bin", "task", "into", "base", "entry", "block", "w0", "found", "key", "part", "size_", "a`b", "a.b",
]


def test_columns_of_any_name(spark, odd, odd_rows):
    """Every operator keeps extra columns with the names that are used inside, and their values."""
    docs = odd.where("text is null or length(text) < 5000").withColumns({n: F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for n in NAMES})
    labels = spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(odd_rows) if r[0]], "doc_id bigint, quality int, toxic int").dropDuplicates(["doc_id"])
    pages = docs.withColumn("url", F.concat(F.lit("http://h.net/"), F.coalesce("doc_id", F.lit(0)))).withColumn("html", F.col("text"))
    model, field = toxicity.fit(docs, labels), line_crf.fit(docs, labels)
    media = jpeg.encode_payload(docs)
    found = {
        "op1": media, "op1 read": jpeg.decode_media(media.drop("n_bytes")), "op3": html_text.extract(pages), "op4": toxicity.score(docs, model), "op5": histogram_sort.shard_documents(docs),
        "op6": line_crf.judge(docs, field), "op7": best_fit.pack_documents(docs, BPE), "op8": poisson_mix.mix_sources(docs, epochs=3.0), "op9": token_counts.count_tokens(docs, PIECES),
        "op10": simhash.near_duplicates(docs), "op10 kept": simhash.keep_one(docs), "op11": token_align.align_tokens(docs, BPE, PIECES), "op13": url_filter.judge_urls(pages, pages.limit(3)),
    }
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    for name, df in found.items():
        made = [n for n in NAMES if n in df.columns]
        # an output replaces an input of its name
        assert len(made) >= len(NAMES) - 3, (name, set(NAMES) - set(made))
        rows = df.select("doc_id", *[F.col("`" + n.replace("`", "``") + "`") for n in made]).collect()
        outputs = {n for n in made if any(r[n] != f"{n}:{'null' if r.doc_id is None else r.doc_id}" for r in rows)}
        assert len(outputs) <= 2 and outputs <= {"fp", "pairs", "times"}, (name, outputs)
        assert name in ("op7", "op8", "op10 kept") or Counter(r.doc_id for r in rows) == ids, name


@pytest.mark.parametrize("rate", [0.7, 30.0, 33.0, 100.0, 1000.0])
def test_counts_are_poisson_at_any_rate(spark, rate):
    n = 4000
    counts = np.array([r.c for r in spark.range(n).select(poisson_mix.count(F.col("id").cast("string"), F.lit(rate), 42).alias("c")).collect()])
    assert abs(counts.mean() - rate) < 5 * (rate / n) ** 0.5
    assert abs(counts.var() / rate - 1) < 5 * (2 / n) ** 0.5 + 1 / (rate * n) ** 0.5
