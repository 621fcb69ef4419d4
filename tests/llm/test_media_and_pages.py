"""JPEG media, WARC archives, page text, toxicity, line labels and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideguard.llm import html_text, jpeg, line_crf, toxicity, warc
from tideguard.llm.common import new_path

DATA = "/root/testdata/sf0.001"


# --- JPEG -----------------------------------------------------------------------------------------------------------


def bits_of(values):
    """(value, width) pairs as entropy-coded bytes, padded by ones and stuffed."""
    text = "".join(format(v, f"0{n}b") for v, n in values if n)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def plain_jpeg(planes, sampling, interval, rng):
    """A JPEG of DC terms (a grid a component) with some AC terms, by its own slow writer; quantiser 16 for all."""
    dc_symbols, ac_symbols = list(range(12)), [0x00, 0xF0, 0x01, 0x12, 0x05, 0x21]
    dc_code = {s: (i, 4) for i, s in enumerate(dc_symbols)}
    ac_code = {s: (i, 3) for i, s in enumerate(ac_symbols)}
    h = max(x for x, _ in sampling)
    v = max(y for _, y in sampling)
    down, across = planes[0].shape[0] // sampling[0][1], planes[0].shape[1] // sampling[0][0]
    if len(planes) == 1:
        h = v = 1
        down, across = planes[0].shape
        sampling = [(1, 1)]
    scan, bits, last, n = b"", [], [0] * len(planes), 0

    def amplitude(x):
        s = abs(x).bit_length()
        return s, (x if x >= 0 else x + (1 << s) - 1)

    for my in range(down):
        for mx in range(across):
            if interval and n and n % interval == 0:
                scan += bits_of(bits) + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
                bits, last = [], [0] * len(planes)
            for c, (p, (x, y)) in enumerate(zip(planes, sampling)):
                for by in range(y):
                    for bx in range(x):
                        dc = int(p[my * y + by, mx * x + bx])
                        s, extra = amplitude(dc - last[c])
                        last[c] = dc
                        bits += [dc_code[s], (extra, s)]
                        k = 1
                        while k <= 63 and rng.random() < 0.7:
                            symbol = rng.choice(ac_symbols[1:])
                            run, size = symbol >> 4, symbol & 15
                            if k + run > 63:
                                break
                            bits += [ac_code[symbol], (rng.randrange(1 << size) if size else 0, size)]
                            k += run + 1
                        if k <= 63:
                            bits.append(ac_code[0])
            n += 1
    scan += bits_of(bits)
    table = lambda kind, code, width: jpeg.segment(0xC4, bytes([kind] + [len(code) if i == width - 1 else 0 for i in range(16)] + list(code)))
    frame = struct.pack(">BHHB", 8, down * v * 8, across * h * 8, len(planes)) + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(sampling))
    sos = bytes([len(planes)]) + b"".join(bytes([i + 1, 0x00]) for i in range(len(planes))) + bytes([0, 63, 0])
    rest = jpeg.segment(0xFE, b"a comment") + jpeg.segment(0xDB, bytes([0] + [16] * 64)) + table(0, dc_symbols, 4) + table(0x10, ac_symbols, 3)
    return b"\xff\xd8" + rest + jpeg.segment(0xDD, struct.pack(">H", interval)) + jpeg.segment(0xC0, frame) + jpeg.segment(0xDA, sos) + scan + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
@pytest.mark.parametrize("interval", [0, 1, 5])
def test_any_baseline_jpeg(sampling, interval):
    rng = random.Random(1)
    files, want = [], []
    for down, across in [(1, 1), (3, 4), (2, 7)]:
        planes = [np.array([[rng.randint(-60, 60) for _ in range(across * x)] for _ in range(down * y)]) for x, y in sampling]
        files.append(plain_jpeg(planes, sampling, interval, rng))
        want.append(np.clip(planes[0] * 2 + 128, 0, 255))
    thumbs = jpeg.thumbnails([p for f in files for p in jpeg.parse(f)])
    assert all(np.array_equal(t, w) for t, w in zip(thumbs, want, strict=True))


def scans_apart(planes, sampling, interval, rng, order, size):
    """A colour JPEG with a scan a component, in the given order; size: its width and height. AC terms are left out."""
    h, v = max(x for x, _ in sampling), max(y for _, y in sampling)
    table = lambda kind, code: jpeg.segment(0xC4, bytes([kind] + [len(code) if i == 3 else 0 for i in range(16)] + list(code)))
    frame = struct.pack(">BHHB", 8, size[1], size[0], 3) + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(sampling))
    out = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0] + [16] * 64)) + table(0, range(12)) + table(0x10, [0]) + jpeg.segment(0xDD, struct.pack(">H", interval)) + jpeg.segment(0xC0, frame)
    for c in order:
        x, y = sampling[c]
        across, down = -(-(-(-size[0] * x // h)) // 8), -(-(-(-size[1] * y // v)) // 8)
        bits, last, scan = [], 0, b""
        for n, dc in enumerate(planes[c][:down, :across].reshape(-1).tolist()):
            if interval and n and n % interval == 0:
                scan += bits_of(bits) + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
                bits, last = [], 0
            d, last = dc - last, dc
            s = abs(d).bit_length()
            bits += [(s, 4), (d if d >= 0 else d + (1 << s) - 1, s), (0, 4)]
        out += jpeg.segment(0xDA, bytes([1, c + 1, 0, 0, 63, 0])) + scan + bits_of(bits)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (2, 2), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 3])
def test_components_in_scans_of_their_own(sampling, interval):
    rng = random.Random(18)
    for order in ((0, 1, 2), (2, 0, 1)):
        for size in ((8, 8), (50, 33), (17, 100)):
            planes = [np.array([[rng.randint(-60, 60) for _ in range(40)] for _ in range(40)]) for _ in sampling]
            got = jpeg.thumbnails(jpeg.parse(scans_apart(planes, sampling, interval, rng, order, size)))[0]
            x, y = sampling[0]
            across, down = math.ceil(math.ceil(size[0] * x / max(a for a, _ in sampling)) / 8), math.ceil(math.ceil(size[1] * y / max(b for _, b in sampling)) / 8)
            assert np.array_equal(got, np.clip(planes[0][:down, :across] * 2 + 128, 0, 255))


def test_payloads_are_lossless(monkeypatch):
    rng = random.Random(2)
    payloads = [jpeg.padded(bytes(rng.randrange(256) for _ in range(n))) for n in (0, 1, 191, 192, 193, 5000)] + [b"\xff" * 1920, b"\x00\xff" * 960]
    for rows in (jpeg.MOST_ROWS, 2):
        monkeypatch.setattr(jpeg, "MOST_ROWS", rows)
        for p, m in zip(payloads, jpeg.encode_payloads(payloads), strict=True):
            assert b"".join(t.tobytes() for t in jpeg.thumbnails(jpeg.parse(m))) == p
    assert all(len(p) % 192 == 0 and p for p in payloads)


def test_media_of_odd_rows(odd, odd_rows, empty):
    media = jpeg.encode_payload(odd.withColumn("MEDIA", F.lit(1)), keep=["doc_id", "lang"])
    got = jpeg.decode_media(media).collect()
    want = Counter((r[0], len((r[1] or "").encode()), jpeg.padded((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r.n_bytes, bytes(r.pixels)) for r in got) == want
    assert all(r.error is None and r.feature.startswith(f"{r.width}x{r.height}x1:") for r in got)
    assert jpeg.decode_media(jpeg.encode_payload(empty)).count() == 0


def test_broken_media(spark):
    good = jpeg.encode_payloads([b"a" * 192])[0]
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:150]), (6, good.replace(b"\xff\xc0", b"\xff\xc2")), (7, good[:-40] + b"\xff\xd9"), (8, good)]
    got = {r.id: r for r in jpeg.decode_media(spark.createDataFrame(rows, "id int, media binary").coalesce(1)).collect()}
    assert [i for i in got if got[i].error is None] == [1, 8]
    assert all(got[i].pixels is None for i in (2, 3, 4, 5, 6, 7))
    bare = jpeg.decode_media(spark.createDataFrame([(good[: good.index(b"\xff\xda")] + b"\xff\xd9",), (b"\xff\xd8\xff\xd9",), (good,)], "media binary").coalesce(1)).collect()
    assert [r.error for r in bare] == ["no scan of luminance", "no scan of luminance", None]


def test_media_query(spark):
    from tideguard.llm.jpeg import query

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in query(spark, DATA).collect():
        p = jpeg.padded(docs[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64


def test_long_payloads_are_worked_on_in_bounded_parts(spark, monkeypatch):
    most = []
    decode = jpeg.decode_lanes
    monkeypatch.setattr(jpeg, "decode_lanes", lambda lanes, *rest: most.append(sum(map(len, lanes))) or decode(lanes, *rest))
    rng = random.Random(17)
    data = bytes(rng.randrange(256) for _ in range(192 * 1000)) * 40
    files = jpeg.encode_payloads([data])
    assert b"".join(t.tobytes() for t in jpeg.thumbnails(jpeg.parse(files[0]))) == data and max(most) <= jpeg.AT_ONCE
    monkeypatch.undo()
    text = ("A long line of text, and on. " * 90_000)[: 192 * 8191 + 100]
    got = jpeg.decode_media(jpeg.encode_payload(spark.createDataFrame([(text,), ("short",)], "text string"))).collect()
    assert sorted(bytes(r.pixels).decode().rstrip() for r in got) == sorted([text.rstrip(), "short"])
    assert {r.pictures for r in got} == {2, 1} and bytes(got[0].media) in (jpeg.encode_payloads([jpeg.padded(t.encode())])[0] for t in (text, "short"))


# --- WARC -----------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", "other\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"), (4, None, None), (5, "http://a/5\r\nX: y", ""),
    (None, "http://a/6", "same"), (7, "http://b/7", "日本 \n\n\r\n é\x00"), (7, "http://b/7", "日本 \n\n\r\n é\x00"), (8, "http://b", "x" * 100_000), (9, "http://b", "x" * 100_000),
]


def test_archives_resolve_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    raw, clean = warc.archive_pages(pages)
    originals = warc.read_archives(spark, raw).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in originals) == Counter((p, (h or "").encode()) for p, _, h in PAGES)
    got = warc.read_archives(spark, clean).collect()
    assert len(got) == len(PAGES)
    b32 = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == Counter((p, b32(h), len((h or "").encode())) for p, _, h in PAGES)
    last = {h or "": max((q for q, _, x in PAGES if (x or "") == (h or "") and q is not None)) for _, _, h in PAGES}
    text = {b32(h): h or "" for _, _, h in PAGES}
    for digest in text:
        records = [r for r in got if r.payload_digest == digest]
        kept = [r for r in records if r.record_type == "response"]
        assert len(kept) == 1 and kept[0].page_id == last[text[digest]] and bytes(kept[0].payload) == text[digest].encode()
        assert all(r.refers_to == kept[0].page_id and r.refers_to_record == kept[0].record_id for r in records if r.record_type == "revisit")


def test_archive_files_are_warc(spark):
    _, clean = warc.archive_pages(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(clean.removeprefix("file://")).glob("*.gz"))
    assert data.count(b"WARC-Profile: " + warc.PROFILE.encode()) == 5  # two of "same", one each of "", page 7 and "xx..."
    at = n = 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        at += len(head) + 4 + int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(PAGES)


def test_a_record_of_more_than_16_mib():
    """Its length fills the last byte of a gzip member, so an empty member follows."""
    import gzip

    for n in (1000, (16 << 20) + 5, 17 << 20):
        data = warc.member({"A": 1}, b"x" * n, n) + warc.LAST.encode()
        assert data[-1] == 0
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nA: 1\r\n") and text.endswith(b"x" * n + b"\r\n\r\n") and text.count(b"x" * 100) == n // 100


def test_least_size_and_empty_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    _, clean = warc.archive_pages(pages, least=5)
    got = Counter(r.record_type for r in warc.read_archives(spark, clean, payloads=False).collect())
    assert got == {"response": 8, "revisit": 2}
    _, clean = warc.archive_pages(pages.limit(0))
    assert warc.read_archives(spark, clean).count() == 0


def test_parser_takes_any_chunks():
    block = b"HTTP/1.1 200 OK\r\n\r\nab\r\n\r\nWARC/1.1"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)
    for size in (1, 7, 1000):
        chunks = [(record * 3)[i : i + size] for i in range(0, 3 * len(record), size)]
        assert [r["payload"] for r in warc.parsed(iter(chunks))] == [b"ab\r\n\r\nWARC/1.1"] * 3
    with pytest.raises(ValueError):
        list(warc.parsed(iter([record[:-9]])))


# --- pages ----------------------------------------------------------------------------------------------------------


def text_of(page):
    lines, kinds = html_text.lines_of(page)
    return html_text.main_text(lines, kinds, [0] * len(lines), None)[0]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b  \n c<br>d</p>", "a\nb c d"),
        ("<nav>menu</nav><article><header><h1>T&eacute;</h1></header><p>x <b>y</b>z</p><aside>no</aside></article><footer>f</footer>", "Té\nx yz"),
        ("<header>top</header><main><div class='ad'>buy<div>more</div></div><p>text</p><div id=comments><p>c</p></div></main>", "text"),
        ("<body><div>a</div><script>var t='</p>';</script><style>p{}</style><!-- <p>x</p> --><form>f<input></form><div role=navigation>n</div><div hidden>h</div>b", "a\nb"),
        ("<article><p>one<p class='notice big'>two<p>three<ul><li>i<li>j</ul><table><tr><td>k<td>l</table></article>", "one\nthree\ni\nj\nk\nl"),
        ("<article><p>unclosed <b>bold<p>next</article><p>after", "unclosed bold\nnext"),
        ("<article><p title='a>b'>q</p><p data-x=\"<p>\">r</p><a href='x>y'>s</a>", "q\nr\ns"),
        ("<article><p>x <span class=ad>buy</span></p>&nbsp;y&#8212;&lt;z&gt;", "x\ny—<z>"),
        ("<nav>never closed<article>a</article>", ""),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html class=nav><body class='has-sidebar menu'><main id=form><article class='post social'><p>a<p class='widget-history'>b</article></main>", "a\nb"),
        ("<div id='page' class='no-comments'><p>a</div><div class='cookie-banner'>x</div><div class='big ads'>y</div><div id=ad_2>z</div>", "a"),
        ("<article><p>a<svg viewBox='0 0 1 1'/>b<svg/><p>c<svg><text>x</text></svg>d</article>", "ab\ncd"),
        ("<title>t<article><p>a<iframe src='x'><p>b<object data=x/>c<iframe><p>d</article>", "a\nbc\nd"),
        ("<article><p>a<iframe src=http://x/>no</iframe>b</article><script>var x='<p>c</p>'", "ab"),
    ],
)
def test_classes_and_raw_elements_keep_the_text(page, want):
    assert text_of(page) == want


def test_a_teaser_is_not_the_main_text():
    page = "<div>Site</div><div>{0} the long text of page {0}</div><div>and more of it</div><article>teaser</article>"
    (lines, kinds), (others, _) = (html_text.lines_of(page.format(i)) for i in (1, 2))
    own, other = ([hash(x) for x in y] for y in (lines, others))
    assert html_text.main_text(lines, kinds, own, None)[0] == "Site\n1 the long text of page 1\nand more of it\nteaser"
    assert html_text.main_text(lines, kinds, own, other) == ("1 the long text of page 1", 3)


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        got = html_text.common(a, b)
        assert got == sorted(set(got)) and len(got) == brute_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_differencing_of_neighbours(spark):
    shell = "<div>Site name</div><div>Follow us</div>{}<div>All rights</div>"
    pages = [(i, f"http://h{i % 2}.org/d{i // 20}/p{i:03}", shell.format(f"<div>own text {i}</div>")) for i in range(60)]
    pages += [(100, "http://alone.org/x", shell.format("<div>lonely</div>")), (101, None, "<p>no url</p>"), (102, "http://e.org/", None)]
    pages += [(i, "http://copy.org/c", "<p>same</p><p>page</p>") for i in (103, 104)] + [(105, "http://r.org/1", "<article>kept</article>"), (106, "http://r.org/2", "<article>kept</article>x")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("N_chars", F.lit(0)).repartition(4)).collect()}
    assert all(got[i].text == f"own text {i}" and got[i].n_shared == 3 for i in range(60))
    assert got[100].text == "Site name\nFollow us\nlonely\nAll rights"
    assert (got[101].text, got[102].text, got[103].text, got[105].text, got[106].text) == ("no url", "", "same\npage", "kept", "kept")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_neighbours_by_longer_common_path(spark):
    rows = [(0, "h", "/a/1", [0]), (1, "h", "/a/2", [1]), (2, "h", "/b/1", [2]), (3, "h", "/b/12", [3]), (4, "i", "/b/12", [4]), (5, "h", "/b/12", [5]), (6, "j", "", [6]), (7, "j", "", [7])]
    df = spark.createDataFrame(rows, "row bigint, host string, path string, hashes array<bigint>")
    got = {r.row: r.other for r in html_text.neighbours(df, ["row"]).collect()}
    assert got == {0: [1], 1: [0], 2: [3], 3: [5], 4: None, 5: [3], 6: [7], 7: [6]}


def test_differencing_decides_blocks_of_containers(spark):
    """Sites whose articles hold unmarked boilerplate: without the alignment most pages would have other texts."""
    page = "<div>Site</div><article><h1>Same title</h1><div>By the newsroom</div><p>Own text {0}.</p><p>A shared passage.</p><ul><li>Read more</li><li>Print</li></ul>{0}</article><div>Rights</div>"
    rows = [(i, f"http://h{i % 3}.org/{i // 30}/{i:03}", page.format(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for c in ("other", "k1", "k2", "packed", "place", "data", "__salt", "hashes"):
        df = df.withColumn(c, F.lit("mine"))
    got = html_text.extract(df).collect()
    assert all(r.text == f"Same title\nOwn text {r.page_id}.\nA shared passage.\n{r.page_id}" and r.n_shared == 7 and (r.other, r.k1, r.hashes) == ("mine",) * 3 for r in got)
    alone = [text_of(p) for _, _, p in rows]
    assert sum(a == r.text for a, r in zip(alone, got)) < 10


def test_a_page_is_paired_with_another_before_a_copy(spark):
    rows = [(0, "h", "/a/1", [1, 2]), (1, "h", "/a/2", [1, 2]), (2, "h", "/b", [3]), (3, "i", "/x/1", [4]), (4, "i", "/x/1", [4])]
    got = {r.row: r.other for r in html_text.neighbours(spark.createDataFrame(rows, "row bigint, host string, path string, hashes array<bigint>"), ["row"]).collect()}
    assert got == {0: [1, 2], 1: [3], 2: [1, 2], 3: [4], 4: [4]}


def test_one_content_on_most_pages(spark):
    rows = [(i, None, None) for i in range(300)] + [(i, "http://a.org/x", "<p>hot</p>") for i in range(300, 700)] + [(i, f"http://a.org/y{i}", f"<div>hot</div><div>{i}</div>") for i in range(700, 710)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(6)).collect()}
    assert len(got) == 710 and all(got[i] == "" for i in range(300)) and all(got[i] == "hot" for i in range(300, 700)) and all(got[i] == str(i) for i in range(701, 710))


@pytest.mark.parametrize("room", [1, 8, 1 << 22])
def test_alignment_in_bounded_memory(monkeypatch, room):
    monkeypatch.setattr(html_text, "ROW_BYTES", room)
    rng = random.Random(13)
    for _ in range(200):
        a, b = ([rng.randrange(7) for _ in range(rng.randrange(40))] for _ in range(2))
        got = html_text.common(a, b)
        it = iter(b)
        assert got == sorted(set(got)) and len(got) == brute_lcs(a, b) and all(a[i] in it for i in got)


def test_very_long_pages_are_aligned():
    rng = random.Random(14)
    own, other = ([rng.randrange(50_000) if rng.random() < 0.5 else i for i in range(100_000)] for _ in range(2))
    began = time.time()
    tracemalloc.start()
    got = html_text.common(own, other)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 20_000 and time.time() - began < 120 and most < 100_000_000
    it = iter(other)
    assert all(own[i] in it for i in got)


# --- toxicity -------------------------------------------------------------------------------------------------------


def comments(n, seed):
    """Insults alone and group words alone are harmless; together they are toxic."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(40)) for _ in range(rng.randint(5, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(["fool", "rotten"])] * insult + [rng.choice(["gruppa", "tribe"])] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_of_terms_are_learnt(spark):
    rows, labels = comments(1500, 5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == y for i, y in unseen) / len(unseen)
    assert right > 0.97
    additive = toxicity.Model(model.index, model.bias, model.weights, np.zeros_like(model.factors))
    linear = [toxicity.sigmoid(toxicity.margin(additive, *toxicity.Terms(model.index).vector(rows[i][1]))) for i, _ in unseen]
    assert max(np.mean([(s >= t) == y for s, (_, y) in zip(linear, unseen)]) for t in np.linspace(0, 1, 101)) < right
    again = toxicity.fit(docs.repartition(7), known.repartition(3))
    assert again.index == model.index and np.allclose(again.factors, model.factors)


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    model = toxicity.Model({}, 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    at, x = np.array([0, 3, 4, 8]), np.array([1.0, 0.5, 2.0, 1.5])
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i, j in itertools.combinations(range(4), 2))
    assert np.isclose(toxicity.margin(model, at, x), 0.3 + model.weights[at] @ x + pairs)


def test_held_out_labels_are_not_used(spark):
    rows, labels = comments(400, 7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, flipped))
    assert a.index == b.index and np.array_equal(a.weights, b.weights)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1), (7, 0), (9, 0), (10, 1), (101, 0)], "doc_id bigint, toxic int")
    got = toxicity.score(odd.withColumn("Score", F.lit("x")), toxicity.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_of_given_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = Counter((labels[r.doc_id], r.predicted) for r in got)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.85 and hit[0, 1] / (hit[0, 0] + hit[0, 1]) < 0.01


def plain_score(text, model):
    """The machine's score by a sum over all terms and all pairs of them, from words on."""
    counts = Counter()
    for word in re.findall(r"\w+", (text or "").lower()):
        places = {zlib.crc32(word.encode("utf-32-le", "replace")) % (1 << 24)}
        places |= {zlib.crc32(word[:k].encode("utf-32-le", "replace"), 1) % (1 << 24) for k in range(3, 8) if k < len(word)}
        counts.update(places)
    x = {model.index[b]: 1 + math.log(n) for b, n in counts.items() if b in model.index}
    value = model.bias + sum(float(model.weights[i]) * v for i, v in x.items())
    scaled = np.array([model.factors[i].astype(float) * v for i, v in x.items()]).reshape(len(x), model.factors.shape[1])
    value += float(np.triu(scaled @ scaled.T, 1).sum())  # every pair once
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, value))))


def test_scores_equal_sums_over_pairs(spark, odd_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.limit(60).collect()] + [r[1] for r in odd_rows[:14]]
    for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect():
        assert abs(r.score - plain_score(r.text, model)) < 1e-4 and r.predicted == (r.score >= 0.5)


def test_terms_are_those_of_largest_chi_square(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS", 300)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text]
    seen = {0: Counter(), 1: Counter()}
    for i, y in known:
        words = set(re.findall(r"\w+", (text[i] or "").lower()))
        seen[y].update({zlib.crc32(w.encode("utf-32-le")) % (1 << 24) for w in words} | {zlib.crc32(w[:k].encode("utf-32-le"), 1) % (1 << 24) for w in words for k in range(3, 8) if k < len(w)})
    n1 = sum(y for _, y in known)
    n0, chi = len(known) - n1, {}
    for b in set(seen[0]) | set(seen[1]):
        n = seen[0][b] + seen[1][b]
        if n >= 3:
            chi[b] = (seen[1][b] * n0 - seen[0][b] * n1) ** 2 / (n * (n0 + n1 + 1 - n))
    want = sorted(chi, key=lambda b: (-chi[b], b))[:300]
    least = chi[want[-1]]
    assert len(model.index) == 300 and {b for b in model.index if chi[b] > least * 1.000001} == {b for b in want if chi[b] > least * 1.000001}
    assert all(chi[b] >= least * 0.999999 for b in model.index)



# --- line labels ----------------------------------------------------------------------------------------------------


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(8)
    for n in range(1, 8):
        field = line_crf.Field(rng.normal(size=line_crf.N_FEATURES), rng.normal(size=(2, 2)))
        x = [rng.integers(0, line_crf.N_FEATURES, len(line_crf.SIZES)).tolist() for _ in range(n)]

        def value(path):
            return sum(field.weights[f].sum() * y for f, y in zip(x, path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(line_crf.viterbi(field, x)) == best


def test_base_measures(odd, odd_rows, empty):
    field = line_crf.Field(np.ones(line_crf.N_FEATURES), np.zeros((2, 2)))
    got = line_crf.judge(odd.withColumn("KEPT", F.lit(1)), field, keep=["doc_id"]).collect()
    want = Counter((r[0], *(m := brute_measures(r[1])), m[0] < 50 or 100 * m[4] > 50 * m[0]) for r in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)
    assert line_crf.judge(empty, field).count() == 0


def test_random_base_measures():
    rng = random.Random(9)
    field = line_crf.Field(np.zeros(line_crf.N_FEATURES), np.zeros((2, 2)))
    for _ in range(400):
        t = "".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "é", "\xa0", "#", "|"]) for _ in range(rng.randrange(60)))
        assert line_crf.measure(t.encode(), field)[:5] == brute_measures(t), repr(t)


def test_field_learns_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = line_crf.judge(docs, line_crf.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in got}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True] and counts.get((0, True), 0) <= 1
    none = line_crf.fit(docs, labels.limit(0))
    assert line_crf.judge(docs, none).where("kept = base_failed").count() == 0


# --- line labels against plain code ----------------------------------------------------------------------------------

STEPS = [(1, 3, 8, 20, 60), (3, 4.5, 6, 8, 11), (0, 0.02, 0.1, 0.3), (0, 0.1, 0.3, 0.7), (0, 0.05, 0.3), (0.2, 0.4, 0.6, 0.8), (0, 0.2)]


def plain_features(lines):
    """The active features of each line, counted one by one from the text."""
    out = []
    for i, line in enumerate(lines):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
        n = len(words)
        ascii_letters = [re.sub(r"[^A-Za-z]", "", w) for w in words]
        values = [
            n,
            sum(len(w.encode()) for w in words) / n,
            sum(c in "#*$%&|<>" for c in line) / n,
            sum(1 for x in ascii_letters if x and x == x.upper()) / n,
            sum(c == "!" for c in line) / n,
            len({w for w in words}) / n if n >= 8 else 1.0,
            sum(1 for w in words if re.fullmatch(r"[0-9]+", w)) / n,
        ]
        on, base = [], 0
        for value, steps in zip(values, STEPS):
            on.append(base + sum(1 for x in steps if x < value))
            base += len(steps) + 1
        for yes in (n < 8, line.rstrip(" \t\n\r\x0b\x0c")[-1] in '.!?:"', line in lines[:i]):
            on.append(base + int(yes))
            base += 2
        out.append(on)
    return out


def plain_share(text, field):
    """The share of words in content lines of the best of all labellings, and the words."""
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    on = plain_features(lines)
    sizes = [len([w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]) for x in lines]
    best, found = -math.inf, ()
    for path in itertools.product((0, 1), repeat=len(lines)):
        value = sum(sum(field.weights[f] for f in x) for x, y in zip(on, path) if y) + sum(field.moves[a][b] for a, b in zip(path, path[1:]))
        if value > best:
            best, found = value, path
    return (sum(n for n, y in zip(sizes, found) if y) / sum(sizes) if sizes else 0.0), sum(sizes)


def plain_labels(on, field):
    """The best labelling, by the best one of each start that ends in each label."""
    best = {0: (0.0, ()), 1: (0.0, ())}
    for i, x in enumerate(on):
        own = sum(field.weights[f] for f in x)
        best = {y: max((best[p][0] + (field.moves[p][y] if i else 0.0) + own * y, (*best[p][1], y)) for p in ((0, 1) if i else (y,))) for y in (0, 1)}
    return max(best.values())[1]


def test_verdicts_equal_all_labellings(spark, odd_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.fit(docs, labels)
    texts = [r.text for r in docs.limit(400).collect()] + [r[1] for r in odd_rows]
    texts = [t for t in texts if (t or "").count("\n") < 9]
    got = line_crf.judge(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), field).collect()
    assert len(got) == len(texts) > 150
    for r in got:
        share, n = plain_share(r.text, field)
        assert abs(r.content_share - share) < 1e-12 and r.kept == (not r.base_failed and n > 0 and share >= 0.5), r.text
    assert sum(0 < r.content_share < 1 for r in got) > 10


def test_gradient_is_that_of_all_labellings():
    rng = np.random.default_rng(11)
    rows = [{"y": y, "lines": rng.integers(0, line_crf.N_FEATURES, (n, len(line_crf.SIZES))).tolist(), "hashes": list(range(n)), "words": [1] * n, "sizes": [n]} for y, n in ((0, 3), (1, 4))]
    lines = line_crf.Lines(rows)
    y = lines.first_targets()
    params = rng.normal(size=line_crf.N_FEATURES + 4)

    def loss(p):
        total = 0.0
        for r, own in zip(rows, y):
            emit = [p[x].sum() for x in r["lines"]]
            moves = p[line_crf.N_FEATURES :].reshape(2, 2)
            value = lambda path: sum(e for e, on in zip(emit, path) if on) + sum(moves[int(a), int(b)] for a, b in zip(path, path[1:]))
            total += math.log(sum(math.exp(value(path)) for path in itertools.product((0, 1), repeat=len(emit)))) - value(own[: len(emit)])
        return total / 7 + line_crf.DECAY * (p @ p) / 2

    grad, _ = line_crf.gradient(params, lines, y)
    for i in (*range(0, line_crf.N_FEATURES, 7), *range(line_crf.N_FEATURES, line_crf.N_FEATURES + 4)):
        step = np.zeros_like(params)
        step[i] = 1e-5
        assert abs((loss(params + step) - loss(params - step)) / 2e-5 - grad[i]) < 1e-6


def test_lines_are_labelled_apart(spark):
    """Good documents with a line that recurs among others, low ones with a good first line: labels differ inside both."""
    rng = random.Random(12)
    prose = lambda: " ".join(rng.choice(["river", "stone", "walked", "evening", "under", "quietly"]) + rng.choice("abcdefghij") + rng.choice("klmnopqr") for _ in range(30)) + "."
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!"]) + "#" for _ in range(25))
    rows, labels = [], []
    for i in range(200):
        lines = [prose(), prose(), "Share this page", prose()] if i % 4 else [prose(), junk(), junk(), junk()]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 4 > 0)))
    docs, known = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, quality int")
    field = line_crf.fit(docs, known.where("doc_id % 5 > 0"))
    assert line_crf.viterbi(field, plain_features(rows[1][1].split("\n"))) == [1, 1, 0, 1]
    assert line_crf.viterbi(field, plain_features(rows[0][1].split("\n"))) == [1, 0, 0, 0]
    got = {r.doc_id: r for r in line_crf.judge(docs, field).collect()}
    assert all(got[i].kept == bool(y) and 0 < got[i].content_share < 1 for i, y in labels if i % 5 == 0)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 5"
    judged = line_crf.judge(docs, line_crf.fit(docs, labels.where(f"{fold} <> 0")), keep=["doc_id"]).where("not base_failed")
    seen = judged.join(labels.where(f"{fold} = 0"), "doc_id").groupBy("quality", "kept").count().collect()
    counts = Counter({(r.quality, r.kept): r["count"] for r in seen})
    assert counts[1, True] / (counts[1, True] + counts[1, False]) > 0.98 and counts[0, False] / (counts[0, False] + counts[0, True]) > 0.95
    assert judged.where("content_share > 0 and content_share < 1").count() > 0.2 * judged.count()


def test_fits_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame([(i % 30, f"line {i} of text\n" * (i % 7) + "WOW!! " * (20 * (i % 30 < 9))) for i in range(90)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i >= 9), int(i % 3 == 0)) for i in range(30)], "doc_id int, quality int, toxic int")
    a, b = (line_crf.fit(x, labels) for x in (docs, docs.orderBy(F.rand(3)).repartition(7)))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
    a, b = (toxicity.fit(x, labels) for x in (docs, docs.orderBy(F.rand(3)).repartition(7)))
    assert a.index == b.index and np.allclose(a.factors, b.factors)


def test_fitted_lines_are_bounded():
    for n in (0, 1, 32, 33, 64, 65, 100_000):
        cuts = line_crf.chosen_windows(n, b"%d" % n)
        assert sum(hi - lo for lo, hi in cuts) <= line_crf.MOST_WINDOWS * line_crf.WINDOW and all(0 <= lo < hi <= n for lo, hi in cuts)
        assert n > 64 or sum(hi - lo for lo, hi in cuts) == n


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "mixing", "packing"]
    before = docs
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, DATA)
        if name != "packing":
            assert after.columns == docs.columns
            path = new_path(spark, "test-stage")
            after.write.parquet(path)
            after = spark.read.parquet(path)
            assert after.join(before, "doc_id", "left_anti").count() == 0
            assert name == "mixing" or 0.5 * before.count() < after.count() <= before.count()
            before = after
    packed = pipeline.run(spark, DATA)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def brute_mix(rows):
    """Copies of (id, source, text) rows by a plain loop."""
    size = Counter()
    for _, source, text in rows:
        size[source] += len(text.encode())
    whole, weights = sum(size.values()), sum(n**0.5 for n in size.values())
    for i, source, text in rows:
        mean = size[source] ** 0.5 * whole / (weights * size[source])
        u = (int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        term = total = math.exp(-mean)
        k = 0
        while total <= u:
            k += 1
            term *= mean / k
            total += term
        yield from [(i, text)] * k


def test_pipeline_equals_brute_force(spark):
    """Every stage by plain loops over the rows; only the two models are fitted by the operators."""
    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_text_operators import brute_components, brute_simhash

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.fit(docs, labels)

    def good(text):
        n, _, _, _, repeats = brute_measures(text)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        sizes = [len([w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]) for x in lines]
        content = sum(n for n, y in zip(sizes, plain_labels(plain_features(lines), field)) if y)
        return n >= 50 and 100 * repeats <= 50 * n and content >= 0.5 * n

    rows = [r for r in docs.collect() if good(r.text)]
    model = toxicity.fit(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if plain_score(r.text, model) < 0.5]
    points = sorted({brute_simhash(r.text) for r in rows})
    roots = dict(zip(points, brute_components(points, 3), strict=True))
    first = {}
    for r in rows:
        k = roots[brute_simhash(r.text)]
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id in set(first.values())]
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in brute_mix([(r.doc_id, r.source, r.text) for r in rows]):
        ids = [*encoder.encode(text, add_special_tokens=False).ids, 0]
        at, to, k = 0, len(ids) % 2048 or 2048, 0
        while at < len(ids):
            want[(i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes()))] += 1
            at, to, k = to, to + 2048, k + 1
    got = pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
