"""Legacy archive converter: ARC records to WARC records, WARC files written and read.

An ARC stream opens with a version block (``filedesc://``) whose second part names the
version and the fields of every header line after it; a header line is followed by as
many bytes as its last field declares. The converter reads either version by its own
field list and synthesises the WARC record: identifier (from the SHA-1 of address, date
and payload), timestamp (14 digits to ISO 8601), type, payload digest. Equal payloads of
at least ``REVISIT_BYTES`` are stored once: the record of the largest page id is the
response, the others are revisits that refer to it.

Payloads are bytes of any kind. ARC header lines have no field for a page id, so the ids
of a block's records go beside it, as a column of their own; archives that come without
that column get null ids.

WARC files are gzip files in the shared folder, written by Spark's text writer with the
record separator as line separator (it writes the bytes as they are), hence with its
commit protocol, and read as whole files that are parsed by declared lengths. A file
holds at most ``FILE_RECORDS`` records of what one task wrote; reading unpacks a file
record by record and passes rows on in batches of about ``BLOCK_BYTES``.

Defined cases: a null payload is empty; a null address is ``about:blank``; spaces and
control characters in an address are percent-encoded; a null page id is kept, counts as
smaller than any other, and records that all have none are all responses; repeated rows
whose id is the largest of their payload are all responses; payloads of any length are
kept whole; header lines that are not UTF-8 are read as Latin-1; a block whose ids are
not as many as its records fails; an empty table gives no records; extra columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: equal payloads of at least so many bytes are stored once
REVISIT_BYTES = 1000
#: bytes of an ARC block, about
BLOCK_BYTES = 4 << 20
#: records of a WARC file, at most
FILE_RECORDS = 4096

# The header fields of the two ARC versions, as the version block names them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = ("page_id long, url string, warc_date string, content_type string, record_id string, arc_version int, "
          "payload_bytes long, payload_digest string, payload binary")


# ------------------------------------------------------------------ ARC
def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 converter\n{ARC_FIELDS[version]}\n".encode()
    if version == 1:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content_type: str, payload: bytes, name: str, offset: int) -> bytes:
    if version == 1:
        head = f"{url} 0.0.0.0 {date} {content_type} {len(payload)}\n"
    else:
        checksum = hashlib.md5(payload).hexdigest()
        head = f"{url} 0.0.0.0 {date} {content_type} 200 {checksum} - {offset} {name} {len(payload)}\n"
    return head.encode() + payload + b"\n"


def _line(f: BinaryIO) -> bytes:
    line = f.readline()
    while line in (b"\n", b"\r\n"):  # records may be set off by blank lines
        line = f.readline()
    return line.rstrip(b"\r\n")


def _text(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"an archive ends within a record: {len(data)} of {n} bytes")
    return data


def read_arc(f: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, header fields, payload) of each record of an ARC stream, the version block left out."""
    version = 0
    names: list[str] = []
    while head := _line(f):
        if head.startswith(b"filedesc://"):
            body = _exactly(f, int(head.rsplit(b" ", 1)[1]))
            first, fields = _text(body).splitlines()[:2]
            version, names = int(first.split()[0]), fields.split()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        if not version:
            raise ValueError("an ARC stream must open with its version block")
        values = _text(head).rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"an ARC {version} header needs {len(names)} fields: {head[:100]!r}")
        fields = dict(zip(names, values))
        yield version, fields, _exactly(f, int(fields["Archive-length"]))


def pages_as_arc(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
                 date: str = "20200101000000") -> DataFrame:
    """Pages as ARC blocks, versions 1 and 2 in turn: a complete stream of some records, and their page ids in order."""
    def block(out: bytearray, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"content": pa.array([bytes(out)], pa.binary()),
                                           "page_ids": pa.array([ids], pa.list_(pa.int64()))})

    def run(batches):
        k, out, ids = 0, bytearray(), []
        for b in batches:
            for page, address, payload in zip(*(c.to_pylist() for c in b.columns)):
                version = 1 + k % 2
                name = f"pages-{k}.arc"
                if not out:
                    out += arc_version_block(version, name, date)
                address = quote(address if address is not None else "about:blank", safe="%/:=&?~#+!$,;'@()*[]")
                out += arc_record(version, address, date, "text/html", payload or b"", name, len(out))
                ids.append(page)
                if len(out) >= BLOCK_BYTES:
                    yield block(out, ids)
                    out.clear()
                    ids = []
                    k += 1
        if out:
            yield block(out, ids)

    return pages.select(F.col(id).cast("long"), F.col(url), F.col(html).cast("binary")).mapInArrow(
        run, "content binary, page_ids array<long>")


# ------------------------------------------------------------------ conversion
def iso_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def synthetic_id(*parts: bytes) -> str:
    """A version-5 style UUID from what the old record holds; the same record always gets the same."""
    h = bytearray(hashlib.sha1(b"\0".join(parts)).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    return f"urn:uuid:{uuid.UUID(bytes=bytes(h))}"


def opened(data: bytes) -> BinaryIO:
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def convert_arc(blocks: DataFrame, payloads: bool = True) -> DataFrame:
    """WARC records (not yet told apart as responses and revisits) of ARC streams in column ``content``.

    ``blocks`` may be archive files read as ``binaryFile`` or the rows of ``pages_as_arc``,
    whose column ``page_ids`` names the page of each record.
    """
    def run(batches):
        for b in batches:
            for content, ids in zip(b.column(0), b.column(1)):
                rows, held, pages, k = [], 0, ids.as_py(), 0
                for k, (version, f, payload) in enumerate(read_arc(opened(content.as_py())), 1):
                    page = pages[k - 1] if pages is not None and k <= len(pages) else None
                    digest = hashlib.sha1(payload).hexdigest()
                    rid = synthetic_id(f["URL"].encode(), f["Archive-date"].encode(), digest.encode(), str(page).encode())
                    rows.append((page, f["URL"], iso_date(f["Archive-date"]), f["Content-type"], rid, version, len(payload), digest,
                                 payload if payloads else None))
                    held += len(payload)
                    if held > BLOCK_BYTES:
                        yield _records(rows)
                        rows, held = [], 0
                if pages is not None and len(pages) != k:
                    raise ValueError(f"a block of {k} records comes with {len(pages)} page ids")
                if rows:
                    yield _records(rows)

    ids = F.col("page_ids") if "page_ids" in blocks.columns else F.lit(None).cast("array<long>").alias("page_ids")
    return blocks.select("content", ids).mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def with_revisits(records: DataFrame, digests: DataFrame) -> DataFrame:
    """Adds record_type, refers_to (page id) and refers_to_record.

    ``digests``: the same records without payloads. Only digests that occur more than
    once are joined; they are counted with map-side combine, and the join may split
    the records of a hot digest.
    """
    many = digests.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "record_id")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "payload_digest", F.col("kept.page_id").alias("kept_page"), F.col("kept.record_id").alias("kept_record"))
    j = records.join(many, "payload_digest", "left")
    again = F.col("kept_record").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_page"))
    return j.select(
        *(c for c in records.columns), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("kept_page")).alias("refers_to"), F.when(again, F.col("kept_record")).alias("refers_to_record"))


# ------------------------------------------------------------------ WARC
def write_warc(records: DataFrame, path: str) -> None:
    """One WARC record per row, gzip files under ``path``; a revisit holds no payload."""
    revisit = F.col("record_type") == "revisit"
    length = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")

    def header(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    text = F.concat(
        F.lit("WARC/1.0\r\n"), header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        header("WARC-Date", F.col("warc_date")), header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_record"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n")).otherwise(""),
        header("X-Page-ID", F.col("page_id").cast("string")), header("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("X-ARC-Version", F.col("arc_version").cast("string")),
        header("Content-Type", F.col("content_type")), header("Content-Length", length), F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record of a WARC stream, by declared lengths."""
    while first := _line(f):
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:60]!r}")
        fields: dict[str, str] = {"version": _text(first)}
        while line := f.readline().rstrip(b"\r\n"):
            name, _, value = _text(line).partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, _exactly(f, int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str, id: str = "page_id", payloads: bool = False) -> DataFrame:
    """Records of the WARC files under ``path``: id, payload size and digest, type, what it refers to.

    Digests of stored payloads are computed anew and must agree with the header.
    """
    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    names = [id, "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for f, data in parse_warc(opened(content.as_py())):
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and hashlib.sha1(data).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
                    rows.append((number(f.get("x-page-id")), number(f["x-payload-length"]), digest, f["warc-type"],
                                 number(f.get("x-refers-to-page-id")), f["warc-record-id"].strip("<>"), f["warc-date"],
                                 data if payloads else None))
                    held += len(data)
                    if payloads and held > BLOCK_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, f"`{id}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, "
             "warc_date string, payload binary")
    return out if payloads else out.drop("payload")


def archive_pages(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages through ARC to WARC files under ``path``, and back as records."""
    blocks = pages_as_arc(pages, id, url, html)
    write_warc(with_revisits(convert_arc(blocks), convert_arc(blocks, payloads=False)), path)
    return read_warc(pages.sparkSession, path, id)
