"""WARC archives with revisit resolution: equal payloads are stored once, later copies as revisit records.

A record is a gzip member of its own, so any record can be read alone from its offset. Spark's text source writes the
members and reads the files, so archives may lie in any store that Spark reaches. Only headers, stored after one read of
the archive, are shuffled by payload digest; payloads move once, compressed, to leave out the revisits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.llm.common import discard, new_path, quoted, rename_files, stored, table, utf8

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, record_type string, page_id bigint, url string, date string, payload_digest string, "
    "refers_to_record string, refers_to bigint, payload_bytes bigint, payload binary"
)
#: A digest of at least one in so many records is hot. So there are no more hot ones than that, and these are broadcast.
HOT_SHARE = 1_024
#: The fastest level: archives are written once and mostly read.
LEVEL = 1
#: The last byte of a member's 32-bit length, which is 0 for all members under 16 MiB, is written as the line separator.
LAST = "\0"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def new_id(archive: str, name: str) -> str:
    """A record's id: unique in all archives, and the same if a lost task is run again."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}:{name}'.encode()).digest(), version=4)}"


def one_line(value: object) -> str:
    """A header's value: line breaks percent-encoded, null as empty."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def member(headers: dict[str, object], payload: bytes | None, said: int) -> bytes:
    """A record as a gzip member, without its last byte (LAST). A revisit has no payload and says the length of it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % said + (payload or b"")
    lines = [f"{name}: {one_line(value)}" for name, value in {**headers, "Content-Length": len(block)}.items()]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    head = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode("utf-8", "replace")
    data = pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()
    if data[-1]:  # a long record is followed by an empty member, which decompresses to nothing
        data += zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()
    return data[:-1]


def common_headers(kind: str, record_id: str, row: dict) -> dict[str, object]:
    return {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": row["date"],
        "WARC-Target-URI": row["url"],
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "X-Page-ID": row["page_id"],
        "Content-Type": "application/http; msgtype=response",
    }


def response(record_id: str, row: dict) -> bytes:
    return member(common_headers("response", record_id, row), row["payload"], len(row["payload"]))


def revisit(archive: str, row: dict) -> bytes:
    """A row of resolve() as a revisit record of an archive: headers only, with the length and digest of the payload left out."""
    origin = row["original"]
    headers = common_headers("revisit", new_id(archive, row["record_id"]), row) | {
        "WARC-Profile": PROFILE,
        "WARC-Refers-To": f"<{new_id(archive, origin['record_id'])}>",
        "WARC-Refers-To-Target-URI": origin["url"],
        "WARC-Refers-To-Date": origin["date"],
        "X-Refers-To-Page-ID": origin["page_id"],
    }
    return member(headers, None, row["payload_bytes"])


def batches_of(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their size in bytes as batches of bounded size."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= 2_000 or size > 16_000_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from batch.slice(at, 500).to_pylist()


def original_records(pages: DataFrame, archive: str) -> DataFrame:
    """Rows of page_id, url, date and payload (binary) -> value, each a response record."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def rows():
            for n, row in enumerate(rows_of(batches)):
                row["payload_digest"] = digest_of(row["payload"])
                value = response(new_id(archive, f"{task}:{n}"), row)
                yield {"value": value}, len(value)

        yield from batches_of(rows(), pa.schema([("value", pa.binary())]))

    return pages.mapInArrow(run, "value binary")


def write_archives(records: DataFrame, path: str) -> None:
    """The members in the column value to gzip WARC files under path, a file a task."""
    spark = records.sparkSession
    records.select(F.col("value").cast("string")).write.option("lineSep", LAST).text(path)
    rename_files(spark, path, ".txt", ".warc.gz")


def parsed(chunks: Iterator[bytes], verify: bool = True) -> Iterator[dict]:
    """The records of a stream of bytes, by their Content-Length, so payloads may hold anything."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            while at < len(held) and held[at] in b"\r\n":  # blank lines between records
                at += 1
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            fields = {}
            for line in bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(": ")
                fields[name.lower()] = value
            first = end + 4
            last = first + int(fields["content-length"])
            if len(held) < last + 4:
                break
            http, _, payload = bytes(held[first:last]).partition(b"\r\n\r\n")
            at = last + 4
            again = fields["warc-type"] == "revisit"
            said = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            page, origin = fields.get("x-page-id", ""), fields.get("x-refers-to-page-id", "")
            yield {
                "record_id": fields["warc-record-id"].strip("<>"),
                "record_type": fields["warc-type"],
                "page_id": int(page) if page else None,
                "url": fields.get("warc-target-uri"),
                "date": fields.get("warc-date"),
                "payload_digest": digest if again or digest and not verify else digest_of(payload),
                "refers_to_record": fields.get("warc-refers-to", "").strip("<>") or None,
                "refers_to": int(origin) if origin else None,
                "payload_bytes": said if again else len(payload),
                "payload": None if again else payload,
            }
        del held[:at]
    if held:
        raise ValueError(f"an archive ends inside a record: {bytes(held[:80])!r}")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of the archives under path, cut at blank lines, which chunks() puts back."""
    return spark.read.option("lineSep", "\r\n\r\n").text(path).select(F.col("value").cast("binary"))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield b"\r\n\r\n".join([*batch.column(0).slice(at, 500).to_pylist(), b""])


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records under path. Digests and lengths of responses are computed from the payload bytes as read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD if payloads else RECORD.rpartition(",")[0])
    arrow = to_arrow_schema(schema)

    def run(batches):
        def rows():
            for row in parsed(chunks(batches)):
                size = len(row["payload"] or b"") if payloads else 200
                if not payloads:
                    del row["payload"]
                yield row, size

        yield from batches_of(rows(), arrow)

    return stream(spark, path).mapInArrow(run, schema)


def rewritten(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """record_id and value: every response under path as a record of another archive, with headers of its own."""

    def run(batches):
        def rows():
            for row in parsed(chunks(batches), verify=False):
                value = response(new_id(archive, row["record_id"]), row)
                yield {"record_id": row["record_id"], "value": value}, len(value)

        yield from batches_of(rows(), pa.schema([("record_id", pa.string()), ("value", pa.binary())]))

    return stream(spark, path).mapInArrow(run, "record_id string, value binary")


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Headers of responses -> those that become revisits, with original, the record they refer to.

    Of the records with one digest and length, at least least bytes long, the one with the largest page_id (then
    record_id) stays. One aggregate finds it, with partial sums before the shuffle; digests that occur once are left
    out. A digest that many records share isn't shuffled for the join: hot ones, HOT_SHARE at most, are broadcast.
    """
    heads = headers.where(F.col("payload_bytes") >= least)
    key = ["payload_digest", "payload_bytes"]
    last = F.max(F.struct("page_id", "record_id", "url", "date"))
    originals = stored(heads.groupBy(*key).agg(F.count("*").alias("n"), last.alias("original")).where("n > 1"), "originals")
    many = F.col("n") * HOT_SHARE >= heads.count()
    hot = F.broadcast(originals.where(many).drop("n"))
    found = heads.join(hot, key).unionByName(heads.join(hot.drop("original"), key, "left_anti").join(originals.where(~many).drop("n"), key))
    return found.where("record_id <> original.record_id")


def revisits(repeats: DataFrame, archive: str) -> DataFrame:
    def run(batches):
        def rows():
            for row in rows_of(batches):
                value = revisit(archive, row)
                yield {"value": value}, len(value)

        yield from batches_of(rows(), pa.schema([("value", pa.binary())]))

    return repeats.mapInArrow(run, "value binary")


def archive_pages(
    pages: DataFrame, *, least: int = 0, id_col: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None
) -> tuple[str, str]:
    """Write pages as response records, read them back, resolve revisits, and write deduplicated archives.

    Returns the two folders. Each record of either has an id of its own; a revisit names its original by id, URI and date.
    date is the time of capture of all pages (by default now, in UTC), which the second archive keeps. A null payload is
    empty; null ids and urls are empty headers, and such pages still refer and are referred to by record; repeated rows
    are records of their own; payloads of any length and content are kept; an empty table gives archives without
    records; other columns are ignored.
    """
    spark = pages.sparkSession
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(quoted(id_col).cast("bigint").alias("page_id"), quoted(url).cast("string").alias("url"), F.lit(when).alias("date"), utf8(payload).alias("payload"))
    raw, clean = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write_archives(original_records(rows, raw), raw)
    headers = stored(read_archives(spark, raw, payloads=False), "headers")
    repeats = stored(resolve(headers, least), "revisits")
    kept = rewritten(spark, raw, clean).join(repeats.select("record_id"), "record_id", "left_anti").select("value")
    write_archives(kept.unionByName(revisits(repeats, clean)), clean)
    discard(spark, headers, repeats)
    return raw, clean


def query(spark, sf_dir: str) -> DataFrame:
    raw, clean = archive_pages(table(spark, sf_dir, "pages"))
    discard(spark, raw)
    return read_archives(spark, clean, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
 d as (select page_id, html, sha1(html) as h, max(page_id) over (partition by html) as last from p)
select page_id, strlen(html) as payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(h, (10 * (i // 8) + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), '') as payload_digest,
 case when page_id = last then 'response' else 'revisit' end as record_type,
 case when page_id = last then null else last end as refers_to
from d
"""
