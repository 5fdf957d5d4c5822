"""WARC archives: one gzip member per record, written and read by Spark.

Writing goes through Spark's own text writer, so it reaches any Hadoop file
system and commits like every other Spark job.  A row is a whole archive of
bounded size without its last byte, which the writer puts back as the row's
separator: a member ends in the top byte of its length field, which is zero
below 16 MiB.  An archive whose last record is longer gets a short warcinfo
record behind it.  Reading inflates each archive step by step, frames records
by their Content-Length and checks the digests that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches, cut, marked

STEP = 1 << 16
#: Records, and compressed bytes but for the last record, of one archive; a file is read as one row.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2_000, 16 << 20
#: Record types of pages, the only ones that read() returns.
PAGE_TYPES = ("response", "revisit", "resource", "conversion")
FIELDS = "page_id bigint, url string, html string, record_type string, refers_to bigint"
OUT = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


class WarcError(ValueError):
    """A damaged archive: bad gzip data, framing or digest."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(record: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def info(date: str) -> bytes:
    """A warcinfo record."""
    block = b"software: tidelog\r\nformat: WARC File Format 1.0\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, record_type: str, refers_to, date: str) -> bytes:
    """A response record with its payload, or a revisit record without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if record_type == "response" else http
    head = [("WARC-Type", record_type), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    head.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
    if record_type == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
        head.append(("WARC-Refers-To", record_id(refers_to)))
    head.append(("Content-Type", "application/http; msgtype=response"))
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes | memoryview):
    """The inflated bytes of each gzip member, read in steps."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflater, out = zlib.decompressobj(31), []
        while not inflater.eof:
            step = view[at : at + STEP]
            if not len(step):
                raise WarcError("the archive ends inside a gzip member")
            try:
                out.append(inflater.decompress(step))
            except zlib.error as e:
                raise WarcError(f"bad gzip data: {e}") from e
            at += len(step)
        at -= len(inflater.unused_data)
        if whole := b"".join(out):
            yield whole


def _headers(raw: bytes) -> dict[str, str]:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", text))[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _checked(what: str, want: str | None, data: bytes) -> str | None:
    """The base32 SHA-1 that a digest header names; None if there is none or it is of another kind."""
    name, _, value = (want or "").rpartition(":")
    if not value or name.lower() not in ("", "sha1"):
        return None
    if len(value) == 40:
        value = base64.b32encode(bytes.fromhex(value)).decode() if re.fullmatch("[0-9a-fA-F]{40}", value) else value
    if value.upper() != digest(data):
        raise WarcError(f"wrong {what} digest")
    return value.upper()


def parse(raw: bytes) -> dict:
    """One record; WarcError if its framing or a digest is wrong.

    Header bytes that are not UTF-8 are read as Latin-1.  SHA-1 digests, in
    base32 or hex, are verified and others ignored.  The payload of an HTTP
    response is what follows its head, whatever its own Content-Length says.
    A revisit has no payload; its length and digest are those that it states.
    """
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        raise WarcError("no WARC header")
    head = _headers(raw[:end])
    try:
        n = int(head.get("content-length", ""))
    except ValueError as e:
        raise WarcError("no Content-Length") from e
    block = raw[end + 4 : end + 4 + n]
    if n < 0 or raw[end + 4 + n :] != b"\r\n\r\n":
        raise WarcError("the record does not have its Content-Length")
    _checked("block", head.get("warc-block-digest"), block)
    kind, http, payload = head.get("warc-type", ""), {}, block
    if re.match(r"application/http\s*;.*msgtype\s*=\s*\"?response|application/http$", head.get("content-type", ""), re.I) and kind != "request":
        cut = re.search(rb"\r?\n\r?\n", block)
        http = _headers(block[: cut.start()] if cut else block)
        payload = block[cut.end() :] if cut else b""
    stated = head.get("warc-payload-digest")
    if kind == "revisit":
        length = int(x) if (x := http.get("content-length", "")).isdigit() else len(payload)
        found = (stated or "").rpartition(":")[2] or None
    else:
        length = len(payload)
        found = _checked("payload", stated, payload) or digest(payload)
    uri = head.get("warc-target-uri")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return {
        "page_id": number(head.get("warc-record-id")),
        "url": None if uri is None else re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), uri),
        "record_type": kind,
        "refers_to": number(head.get("warc-refers-to")),
        "payload_bytes": length,
        "payload_digest": found,
        "payload": None if kind == "revisit" else payload,
    }


def _pack(date: str, most_records: int, most_bytes: int):
    def archive(held: list[bytes]):
        if held[-1][-1]:  # a record of 16 MiB or more
            held.append(member(info(date)))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["archive"])

    def run(batches):
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for p, u, h, t, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(member(record(p, u, (h or "").encode(), t, r, date)))
                size += len(held[-1])
                if len(held) >= most_records or size >= most_bytes:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    return run


def _unpack(payloads: bool):
    names = [x.split()[0] for x in OUT.split(", ")][: None if payloads else -1]
    kinds = dict(page_id=pa.int64(), url=pa.string(), record_type=pa.string(), refers_to=pa.int64(), payload_bytes=pa.int64(), payload_digest=pa.string(), payload=pa.binary())

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for raw in members(content.as_buffer()):
                    row = parse(raw)
                    if row["record_type"] not in PAGE_TYPES:
                        continue
                    rows.append(row)
                    size += len(raw) if payloads else 1000
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    return run


def plan_records(pages: DataFrame, least_bytes: int = 0, salts: int = 16) -> DataFrame:
    """Each page's record type and, for revisits, the page it refers to.

    Of the pages with equal payloads of at least ``least_bytes`` bytes the one
    with the largest page_id is the response; rows that repeat that page_id
    with the same payload are responses too.  Null ids are never the largest
    unless a group has no other.  Groups are aggregated before the shuffle.
    Pages whose payload no other page has go straight on, but for few that
    meet a bit of the bitmap of repeated ones; the rest is joined with its
    group, each spread over ``salts`` keys.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.sha1(F.col("html").cast("binary"))).withColumn("long", F.octet_length("html") >= least_bytes)
    last = cut(rows.where("long").groupBy("sum").agg(F.max("page_id").alias("last"), F.count("*").alias("times")).where("times > 1").select("sum", "last"))
    rows = marked(rows, last, "sum")
    alone = rows.where("not (long and marked)").select("page_id", "url", "html", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = rows.where("long and marked").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(last, ["sum", "salt"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return alone.unionByName(rest.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to")))


def write(
    pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_records: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write every page as a record of the ``*.warc.gz`` archives below ``path``.

    A null html is an empty payload, a null url has no target header.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    packed = plan_records(pages, least_bytes).mapInArrow(_pack(date, archive_records, archive_bytes), "archive binary")
    packed.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [n for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("part-") and n.endswith(".txt")]
    with ThreadPool(16) as pool:
        pool.map(lambda n: fs.rename(hadoop.Path(root, n), hadoop.Path(root, n[:-4] + ".warc.gz")), parts)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of a page: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if ``payloads``, the payload (null for revisits).

    Length and digest are those of the full payload, for revisits as well.
    A damaged archive raises WarcError.  A folder without archives is empty.
    """
    schema = OUT if payloads else OUT.rpartition(", ")[0]
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return found.select("content").mapInArrow(_unpack(payloads), schema)
