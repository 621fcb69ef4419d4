"""Main text of web pages: structural blocks, and line differencing against the page nearest by URL path on the same host.

Pages are ordered by (host, path); each is paired with the neighbour of the longer common path (of another content, if either
is), their lines are aligned by a longest common subsequence, and lines that both have are deleted. Exempt is prose of a
container, <article> or <main>: its headings, paragraphs, quotations and bare text, as two articles may well share a passage;
list items, table cells and plain blocks in a container are not. Where containers hold at least as much text as the
lines of the page's own outside them, they are the text. On other pages (no container, or but a teaser in one) differencing
decides every line. Of two pages with the same lines nothing would stay, so these keep all.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import arrow_map, quoted, salted_join, stored, table, utf8, without

# HTML's elements by role, and class, id and role words that mark what is not the article.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOT_TEXT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
ROOTS = {"article", "main"}
NEVER = {"html", "body"} | ROOTS  # no class or id makes these boilerplate
PROSE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"} | ROOTS
OPAQUE = {"script", "style"}  # never text, even if not closed
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
BOILERPLATE = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager",
    "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "signup", "social", "sponsored", "subscribe", "toolbar", "widget",
}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
SELF_CLOSED = re.compile(r"""(?:<[^\s/>]+|[\s"'])/>\Z""")
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[^\W\d_]+")
#: Kinds of lines: boilerplate, outside containers, prose of one, and other blocks in one.
OUT, PLAIN, BODY, BLOCK = range(4)
#: Bytes of the rows that an alignment holds at once; beyond them it halves the page. Lines with so many places are frequent.
ROW_BYTES, FREQUENT = 1 << 22, 64


def excluded(tag: str, attrs: str, in_root: bool) -> bool:
    """Whether an element is boilerplate by its name or attributes. An article's own <header> is part of it.

    A class or id counts if it is one of the words or made of them alone: cookie-banner does, has-sidebar does not.
    """
    if tag in NOT_TEXT or tag == "header" and not in_root:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            marks = {x for x in value.split() if x in BOILERPLATE or BOILERPLATE.issuperset(PARTS.findall(x) or [""])}
            if marks and tag not in NEVER and not (in_root and marks == {"header"}):
                return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """A page's text blocks in order, and the kind of each."""
    lines, kinds, words = [], [], []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate from here on, under a root, prose of it
    drop_p = False
    inner = ""  # the paragraph, list item or cell that is open
    at = 0
    unclosed: set[str] = set()

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            _, bad, root, prose = stack[-1] if stack else ("", False, False, False)
            lines.append(text)
            kinds.append(OUT if bad or drop_p else PLAIN if not root else BODY if (inner in PROSE if inner else prose) else BLOCK)
        words.clear()

    while m := TOKEN.search(page, at):
        words.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:  # a comment or a declaration
            continue
        closing = bool(m["close"] or m["close2"])
        if tag in RAW and not closing:
            if tag == "title":
                flush()
            if not SELF_CLOSED.search(m[0]):
                end = None if tag in unclosed else END[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in OPAQUE:
                    at = len(page)
                else:  # it ends at its own tag, as all of its kind from here on
                    unclosed.add(tag)
            continue
        if tag == "br":
            words.append(" ")
            continue
        _, bad, root, prose = stack[-1] if stack else ("", False, False, False)
        if tag in INLINE:
            if closing:
                if stack and stack[-1][0] == tag:
                    flush()
                    stack.pop()
            elif bad and stack[-1][0] == tag or not bad and m["attrs"] and excluded(tag, m["attrs"], root):
                flush()
                stack.append((tag, True, root, prose))
            continue
        flush()
        drop_p, inner = False, ""
        if tag in VOID:
            continue
        if tag in SELF_CLOSING:
            drop_p = not closing and excluded(tag, m["attrs"] or "", root)
            inner = "" if closing else tag
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            within = root or tag in ROOTS or bool(m["attrs"] and re.search(r"""role\s*=\s*["']?main\b""", m["attrs"], re.I))
            stack.append((tag, bad or excluded(tag, m["attrs"] or "", within), within, tag in PROSE or within and not root))
    words.append(page[at:])
    flush()
    return lines, kinds


def rows_of(a: list[int], b: list[int]):
    """After each item of a, the bits of b at which the longest common subsequence of their starts grows are 0."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)

    def mask(x: int) -> int:
        bits = 0
        for j in where.get(x, ()):
            bits |= 1 << j
        return bits

    # masks as long as b are held for frequent items alone, which are few
    frequent = {x: mask(x) for x, at in where.items() if len(at) >= FREQUENT}
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & (frequent[x] if x in frequent else mask(x))
        v = ((v + u) | (v - u)) & full
        yield v


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a and each start of b."""
    for last in rows_of(a, b):  # noqa: B007, only the last is needed, and not all at once
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little", count=len(b))
    return np.r_[0, (1 - bits.astype(np.int64)).cumsum()]


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of a and b: bit-parallel rows and a walk back, after a is halved, with b
    where that loses nothing, until the rows fit in ROW_BYTES."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 8 * ROW_BYTES:
        half = len(a) // 2
        cut = int((lengths(a[:half], b) + lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return aligned(a[:half], b[:cut]) + [half + i for i in aligned(a[half:], b[cut:])]
    rows = [(1 << len(b)) - 1, *rows_of(a, b)]
    found, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of a and b. Common ends, and what only one of them holds, are set aside."""
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    own, other = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in other]
    middle = aligned([a[i] for i in at], [x for x in b[head : len(b) - tail] if x in own])
    return [*range(head), *(at[i] for i in middle), *range(len(a) - tail, len(a))]


def main_text(lines: list[str], kinds: list[int], own: list[int], other: list[int] | None) -> tuple[str, int]:
    """The text and the number of lines shared with the paired page. A copy of it is left as it is."""
    shared = set(common(own, other)) if other else set()
    copy = len(shared)
    if copy == len(own):
        shared = set()
    inside = sum(len(x) for x, k in zip(lines, kinds, strict=True) if k in (BODY, BLOCK))
    outside = sum(len(x) for i, (x, k) in enumerate(zip(lines, kinds, strict=True)) if k == PLAIN and i not in shared)
    rooted = inside and inside >= outside

    def stays(i: int) -> bool:
        if rooted:
            return kinds[i] == BODY or kinds[i] == BLOCK and i not in shared
        return kinds[i] != OUT and i not in shared

    return "\n".join(x for i, x in enumerate(lines) if stays(i)), copy


def neighbours(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of ids, host, path, hashes -> ids, other: the hashes of the neighbour in (host, path) order, of the same host,
    whose path has the longer common start (the one before on a tie); one with other hashes goes before a copy. A range sort
    gives ranks; a join on rank - 1 and rank + 1 then finds neighbours, so a host with any share of the pages is spread."""
    width = 33
    ordered = rows.repartitionByRange("host", "path", *ids).sortWithinPartitions("host", "path", *ids)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    parts = ordered.groupBy(F.shiftright("at", width).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    before, starts = 0, []
    for r in parts:
        starts += [F.lit(r.part), F.lit(before)]
        before += r.n
    if not starts:
        return ordered.select(*ids, F.col("hashes").alias("other")).where("false")
    first = F.create_map(*starts)[F.shiftright("at", width)]
    ranked = ordered.withColumn("rank", first + F.col("at").bitwiseAND(F.lit((1 << width) - 1)))
    heads = F.split(F.col("path"), "")

    def side(step: int, name: str) -> DataFrame:
        return ranked.select((F.col("rank") + step).alias("rank"), F.struct("host", "path", "hashes").alias(name))

    both = ranked.join(side(1, "up"), "rank", "left").join(side(-1, "down"), "rank", "left")

    def alike(name: str):
        same = F.zip_with(heads, F.split(F.col(f"{name}.path"), ""), lambda x, y: x.eqNullSafe(y))
        length = F.coalesce(F.array_position(same, False) - 1, F.size(same).cast("bigint"))
        length = F.when(length < 0, F.size(same)).otherwise(length)
        length = F.when(F.col(f"{name}.hashes") == F.col("hashes"), F.lit(0)).otherwise(length + 1)
        return F.when(F.col(f"{name}.host") == F.col("host"), length).otherwise(F.lit(-1))

    up, down = alike("up"), alike("down")
    chosen = F.when((up < 0) & (down < 0), F.lit(None)).when(up >= down, F.col("up.hashes")).otherwise(F.col("down.hashes"))
    return both.select(*ids, chosen.alias("other"))


def extract(pages: DataFrame, *, page: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Add text, n_chars, n_lines and n_shared (lines that the paired page has too, boilerplate included).

    A null or empty page gives an empty text, a null url is a host and path of its own kind; rows that repeat url and
    page are one page when pages are paired. Blocks are joined by one newline; an empty table gives an empty one;
    columns named as an output are replaced, and others may have any name. Pages of any size are read whole.

    Pairing moves hashes of lines alone. Then each page meets its partner's hashes by a key of its content; for that it
    is compressed, as only this join moves pages. Rows of a content that many pages share are spread over tasks.
    """
    import zstandard

    keep = [c for c in (pages.columns if keep is None else keep) if c in set(without(pages, ["text", "n_chars", "n_lines", "n_shared"]))]
    held = [f"c{i}" for i in range(len(keep))]  # so that no name can clash
    ids = ["k1", "k2"]  # 128 bits of content
    place, data = F.col("place"), F.col("data")
    plain = pages.select(*[quoted(c).alias(h) for c, h in zip(keep, held)], F.coalesce(quoted(url).cast("string"), F.lit("")).alias("place"), utf8(page).alias("data"))
    keyed = plain.withColumn("k1", F.xxhash64(place, data)).withColumn("k2", F.xxhash64(data, place, F.lit(1)))

    def hashed():
        import xxhash

        return lambda values: [[[xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines_of(v.decode("utf-8", "replace"))[0]] for v in values]]

    host = F.lower(F.regexp_extract(place, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host")
    path = F.regexp_extract(place, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path")
    light = arrow_map(keyed.select(*ids, host, path, "data"), [data], "hashes array<bigint>", hashed, [*ids, "host", "path"])
    firsts = [F.first(c).alias(c) for c in ("host", "path", "hashes")]
    different = stored(light.groupBy(*ids).agg(*firsts, F.count("*").alias("n")), "pages")
    others = neighbours(different.drop("n"), ids)

    def small():
        pack = zstandard.ZstdCompressor(level=3).compress
        return lambda values: [[pack(v) for v in values]]

    joined = salted_join(arrow_map(keyed, [data], "packed binary", small, [*held, *ids]), others, ids, different.select("k1", "n"))

    def finish():
        import xxhash

        unpack = zstandard.ZstdDecompressor().decompress

        def one(packed, other):
            lines, kinds = lines_of(unpack(packed).decode("utf-8", "replace"))
            own = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]
            text, shared = main_text(lines, kinds, own, other)
            return text, len(text), len(lines), shared

        def compute(packed, other):
            return [list(c) for c in zip(*map(one, packed, other), strict=True)] or [[]] * 4

        return compute

    found = arrow_map(joined, [F.col("packed"), F.col("other")], "text string, n_chars bigint, n_lines int, n_shared int", finish, held)
    return found.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], "text", "n_chars", "n_lines", "n_shared")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


ORACLE_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages),
 b as (select page_id, url, list_transform(
   string_split_regex(regexp_replace(regexp_replace(body, '<br>', ' ', 'g'), '</?b>', '', 'g'), '<[^>]*>'),
   lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as blocks from a),
 c as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from b)
select page_id, url, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from c
"""
