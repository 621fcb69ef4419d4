"""Media columns: baseline JPEG files, their parsing and Huffman decoding, and DC-only luminance thumbnails, in numpy.

decode_media() reads any baseline (SOF0) grey or colour JPEG: it parses the markers, decodes the scan that holds luminance,
alone or with other components, keeps each luminance block's DC term, and so gives the picture at an eighth of its size. Scans are decoded in lockstep: restart
intervals are independent of each other, so each step decodes the next block of thousands of them at once.

encode_payload() stores bytes without loss in that format: a byte is the DC term of one grey 8 x 8 block, quantised by 8,
so the block's mean, which is its thumbnail's pixel, is the byte itself. A picture has 192 blocks a row and a restart interval
a row. The Huffman table gives category s a code of 9 - s bits, so a block takes 10 bits. Payloads beyond one
picture's height go on in further pictures, one after the other.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import arrow_map, quoted, stored, table, utf8, without

ACROSS = 192
#: Rows of blocks in one picture at most: JPEG's 65,535 lines.
MOST_ROWS = 65_535 // 8
#: Bytes of payload or of scans that are worked on at once.
AT_ONCE = 3_000_000


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def dc_codes() -> np.ndarray:
    """The 10 bits of a block for each difference -255..255: category code, difference bits, end of block."""
    d = np.arange(-255, 256)
    s = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(int) + 1)
    bits = np.where(d >= 0, d, d + (1 << s) - 1)
    return (((((1 << (9 - s)) - 2) << s) | bits) << 1).astype(np.uint64)


CODES = dc_codes()
TABLES = (
    segment(0xDB, bytes([0]) + bytes([8]) * 64)  # every quantiser is 8; only DC is used
    + segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))  # DC: category 8 in 1 bit ... 0 in 9
    + segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))  # AC: the end of block alone, in 1 bit
    + segment(0xDD, struct.pack(">H", ACROSS))
)


def head(rows: int) -> bytes:
    frame = segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
    app = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    return b"\xff\xd8" + app + TABLES + frame + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def padded(value: bytes) -> bytes:
    """value and spaces up to a positive multiple of 192 bytes."""
    return value + b" " * (-len(value) % ACROSS or (0 if value else ACROSS))


def encode_payloads(payloads: Sequence[bytes]) -> list[bytes]:
    """Payloads, each of a positive multiple of 192 bytes, as one or more JPEG files each."""
    if not payloads:
        return []
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ACROSS).astype(np.int16)
    diffs = np.diff(blocks, axis=1, prepend=np.int16(128))
    v = CODES[diffs + 255].reshape(len(blocks), -1, 4)
    x = (v[..., 0] << np.uint64(30)) | (v[..., 1] << np.uint64(20)) | (v[..., 2] << np.uint64(10)) | v[..., 3]
    data = x.astype(">u8").view(np.uint8).reshape(len(blocks), -1, 8)[..., 3:].reshape(len(blocks), -1)  # 240 bytes a row
    counts = [len(p) // ACROSS for p in payloads]
    row = np.concatenate([np.arange(n) for n in counts]) % MOST_ROWS
    lines = np.empty((len(blocks), data.shape[1] + 2), np.uint8)
    lines[:, :-2], lines[:, -2], lines[:, -1] = data, 0xFF, 0xD0 + row % 8
    stuffed = data == 0xFF
    flat = np.insert(lines.reshape(-1), np.flatnonzero(np.pad(stuffed, ((0, 0), (0, 2)))) + 1, 0).tobytes()
    ends = np.cumsum(stuffed.sum(axis=1) + lines.shape[1])
    out, at = [], 0
    for n in counts:
        files = []
        for first in range(at, at + n, MOST_ROWS):
            last = min(first + MOST_ROWS, at + n)
            begin = int(ends[first - 1]) if first else 0
            files += [head(last - first), flat[begin : int(ends[last - 1]) - 2], b"\xff\xd9"]  # no marker after the last interval
        out.append(b"".join(files))
        at += n
    return out


class Picture:
    """One parsed baseline JPEG: its frame, tables and entropy-coded scan, cut at restart markers."""

    __slots__ = ("ac", "components", "dc", "height", "interval", "lanes", "quant", "scan", "width")

    def layout(self) -> tuple[int, int, int, int]:
        """The luminance scan's MCUs across and down, and its blocks across and down one. A scan of one component has MCUs of a
        block, as many as its own size needs; in others they are as many as the largest sampling factors need."""
        _, h, v, _ = self.components[0]
        most_h, most_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.scan) == 1:
            return -(-(-(-self.width * h // most_h)) // 8), -(-(-(-self.height * v // most_v)) // 8), 1, 1
        return -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v)), h, v

    def blocks(self) -> tuple[int, int]:
        """Luminance blocks across and down that show the picture."""
        _, h, v, _ = self.components[0]
        return -(-(-(-self.width * h // max(c[1] for c in self.components))) // 8), -(-(-(-self.height * v // max(c[2] for c in self.components))) // 8)


SCAN_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def parse(data: bytes) -> list[Picture]:
    """All JPEG files that follow one another in data. Raises ValueError for what is not baseline JPEG."""
    found, at = [], 0
    picture, quant, huffman, interval = Picture(), {}, {}, 0
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError("no JPEG marker")
        marker, at = data[at + 1], at + 2
        if marker == 0xFF:
            at -= 1
        elif marker == 0xD8:
            picture, quant, huffman, interval = Picture(), {}, {}, 0
        elif marker == 0xD9:
            if not hasattr(picture, "lanes"):
                raise ValueError("no scan of luminance")
            found.append(picture)
        else:
            (length,) = struct.unpack_from(">H", data, at)
            body, at = data[at + 2 : at + length], at + length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huffman[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                precision, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or n not in (1, 3):
                    raise ValueError("not 8-bit grey or colour")
                picture.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                end = SCAN_END.search(data, at)
                stop = end.start() if end else len(data)
                if picture.components[0][0] in chosen:  # a scan without luminance is passed over
                    picture.scan = [c for c in picture.components if c[0] in chosen]
                    picture.dc = [huffman[chosen[c[0]] >> 4] for c in picture.scan]
                    picture.ac = [huffman[16 + (chosen[c[0]] & 15)] for c in picture.scan]
                    picture.quant, picture.interval = quant[picture.scan[0][3]], interval
                    picture.lanes = [x.replace(b"\xff\x00", b"\xff") for x in RESTART.split(data[at:stop])]
                at = stop
    return found


def lookup(spec: bytes) -> np.ndarray:
    """A Huffman table as 65,536 entries: code length * 256 + symbol for each next 16 bits; length 0 where none is."""
    table, code, at = np.zeros(65_536, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = length * 256 + spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode_lanes(lanes: list[bytes], units: np.ndarray, blocks: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Every lane's DC terms of component 0, as [lane, unit, block of it]; units: a lane's number of MCUs.

    blocks: for each block of an MCU its component and its DC and AC tables. Lanes step together, block by block.
    """
    data = np.frombuffer(b"".join(x + b"\xff" * 8 for x in lanes) + b"\xff" * 8, np.uint8).astype(np.uint64)
    window = np.zeros(len(data) - 7, np.uint64)  # the 40 bits from each byte on
    for i in range(5):
        window |= data[i : len(data) - 7 + i] << np.uint64(32 - 8 * i)
    window = window.astype(np.int64)
    size = np.array([len(x) for x in lanes], np.int64)
    pos = (np.r_[0, np.cumsum(size + 8)[:-1]]) * 8
    limit = pos + size * 8
    tables = {spec: lookup(spec) for _, dc, ac in blocks for spec in (dc, ac)}
    own = [i for i, b in enumerate(blocks) if b[0] == 0]
    out = np.zeros((len(lanes), int(units.max(initial=0)), len(own)), np.int32)
    last = np.zeros((len({b[0] for b in blocks}), len(lanes)), np.int64)

    def symbol(table: np.ndarray, pos: np.ndarray):
        """(symbol, extra bits' value, new position): a code and as many bits as the symbol's low half says."""
        at = np.minimum(pos >> 3, len(window) - 1)
        w, shift = window[at], pos & 7
        found = table[(w >> (24 - shift)) & 0xFFFF]
        length, value = found >> 8, found & 255
        if (length == 0).any():
            raise ValueError("no such Huffman code")
        s = value & 15
        start = pos + length
        at = np.minimum(start >> 3, len(window) - 1)
        extra = (window[at] >> (40 - (start & 7) - s)) & ((1 << s) - 1)
        return value, np.where(extra < (1 << s) >> 1, extra - (1 << s) + 1, extra), start + s

    for unit in range(out.shape[1]):
        live = np.flatnonzero(units > unit) if units.min() <= unit else slice(None)
        for i, (component, dc, ac) in enumerate(blocks):
            _, diff, now = symbol(tables[dc], pos[live])
            last[component, live] += diff
            if component == 0:
                out[live, unit, own.index(i)] = last[component, live]
            pos[live] = now
            rest = np.arange(len(lanes))[live]
            done = np.zeros(len(rest), np.int64)
            while len(rest):  # AC terms only move the position on
                value, _, now = symbol(tables[ac], pos[rest])
                pos[rest] = now
                done = done + (value >> 4) + 1
                more = (value != 0) & (done < 63)
                rest, done = rest[more], done[more]
    if (pos > limit).any():
        raise ValueError("the scan ends early")
    return out


def thumbnails(pictures: list[Picture]) -> list[np.ndarray]:
    """Each picture's luminance at an eighth of its size, from DC terms alone, as bytes [line, column]."""
    result: list = [None] * len(pictures)
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        groups.setdefault((tuple(p.dc), tuple(p.ac), tuple(c[1:3] for c in p.scan)), []).append(i)
    for (dc, ac, sampling), members in ((key, all_[s]) for key, all_ in groups.items() for s in blocks_of([pictures[i].lanes for i in all_])):
        if len(sampling) == 1:
            sampling = ((1, 1),)
        blocks = [(c, dc[c], ac[c]) for c, (x, y) in enumerate(sampling) for _ in range(x * y)]
        lanes, units, spans = [], [], []
        for i in members:
            p = pictures[i]
            across, down, h, v = p.layout()
            total, each = across * down, p.interval or across * down
            if len(p.lanes) != -(-total // each):
                raise ValueError("restart intervals are missing")
            spans.append((len(lanes), len(p.lanes), across, down, h, v))
            lanes += p.lanes
            units += [min(each, total - k * each) for k in range(len(p.lanes))]
        terms = decode_lanes(lanes, np.array(units, np.int64), blocks)
        for i, (first, n, across, down, h, v) in zip(members, spans, strict=True):
            p = pictures[i]
            flat = terms[first : first + n].reshape(-1, h * v)[: across * down]
            grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            wide, high = p.blocks()
            grid = grid[:high, :wide].astype(np.int64)
            result[i] = np.clip((grid * p.quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return result


def average_hash(picture: np.ndarray) -> str:
    """64 bits, in hex: which cells of an 8 x 8 grid over the picture are lighter than their mean."""
    a = picture.astype(np.float64)
    for axis in (0, 1):
        at = np.arange(8) * a.shape[axis] // 8
        a = np.add.reduceat(a, at, axis=axis) / np.maximum(np.diff(np.r_[at, picture.shape[axis]]), 1).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits(a > a.mean()).tobytes().hex()


def blocks_of(values: Sequence[bytes] | Sequence[list[bytes]]) -> list[slice]:
    """Slices of values (or of lists of lanes) of about AT_ONCE bytes each; what is longer has a slice of its own."""
    cuts, held = [0], 0
    for i, v in enumerate(values):
        size = len(v) if isinstance(v, bytes) else sum(map(len, v))
        if held and held + size > AT_ONCE:
            cuts.append(i)
            held = 0
        held += size
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True)]


def encode_payload(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes and media: the text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as JPEG.

    A null text is empty (192 spaces). Texts of any length are stored whole, a picture at a time; equal texts give equal media.
    Repeated rows stay; columns named as an output are replaced; an empty table gives an empty one.
    """
    picture = MOST_ROWS * ACROSS

    def start():
        def encoded(values):
            """Payloads up to a picture's size together, longer ones picture by picture."""
            if len(values) > 1 or len(values[0]) <= picture:
                return encode_payloads(values)
            return [b"".join(encode_payloads([values[0][at : at + picture]])[0] for at in range(0, len(values[0]), picture))]

        def compute(values):
            media = [m for s in blocks_of(values) for m in encoded([padded(v) for v in values[s]])]
            return [len(v) for v in values], media

        return compute

    return arrow_map(docs, [utf8(text)], "n_bytes bigint, media binary", start, without(docs, []) if keep is None else keep)


def decode_media(df: DataFrame, *, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Add width, height, pictures, pixels (the thumbnails' bytes), feature and error, read from a JPEG column.

    What is null or isn't baseline JPEG has an error and nulls. feature is size, pictures and the average hash of all
    thumbnails below one another. Pictures are decoded AT_ONCE bytes at a time, or one by one if they are larger.
    Repeated rows stay; columns named as an output are replaced; an empty table gives an empty one.
    """

    def start():
        def one(data):
            try:
                if data is None:
                    raise ValueError("null")
                parsed = parse(data)
                if not parsed:
                    raise ValueError("no picture")
                return parsed, None
            except (ValueError, KeyError, IndexError, AttributeError, struct.error) as e:
                return [], str(e) or type(e).__name__

        def decoded(batch):
            """Thumbnails of all; if one of them is broken, each is decoded by itself."""
            try:
                flat = iter(thumbnails([p for parsed, _ in batch for p in parsed]))
                return [([next(flat) for _ in parsed], error) for parsed, error in batch]
            except (ValueError, IndexError) as e:
                return [([], str(e))] if len(batch) == 1 else [decoded([x])[0] for x in batch]

        def compute(values):
            rows = []
            for s in blocks_of([v or b"" for v in values]):
                batch = [one(v) for v in values[s]]
                for (parsed, _), (thumbs, error) in zip(batch, decoded(batch), strict=True):
                    if error is not None:
                        rows.append((None, None, None, None, None, error))
                        continue
                    w, h = max(p.width for p in parsed), sum(p.height for p in parsed)
                    same = len({t.shape[1] for t in thumbs}) == 1
                    mark = average_hash(np.concatenate(thumbs) if same else thumbs[0])
                    rows.append((w, h, len(parsed), b"".join(t.tobytes() for t in thumbs), f"{w}x{h}x{len(parsed)}:{mark}", None))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6

        return compute

    outputs = "width int, height int, pictures int, pixels binary, feature string, error string"
    return arrow_map(df, [quoted(media)], outputs, start, without(df, []) if keep is None else keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    media = stored(encode_payload(docs, keep=["doc_id"]), "media", compression="zstd")
    marked = media.withColumn("media_sha256", F.sha2("media", 256)).withColumn("media_bytes", F.length("media").cast("bigint"))
    read = decode_media(marked, keep=["doc_id", "n_bytes", "media_sha256", "media_bytes"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("bigint").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -16, 16)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "width",
        "height",
    )
