"""Legacy ARC archives to WARC: parse version-specific header lines, synthesise WARC records.

An ARC file opens with a `filedesc://` record whose body names its version and field list.
Version 1 records have the five fields

    URL IP-address Archive-date Content-type Archive-length

and version 2 records ten, with the result code, checksum, location, offset and file name
before the length. The body has exactly the declared length; one line end follows it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import fresh_path, staged, width
from inkwell.llm.files import read_whole, write_whole

V1 = ("url", "ip", "date", "type", "length")
V2 = ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 8 << 20
STEP = 8192
MIN_REVISIT = 1000


# --- ARC -----------------------------------------------------------------


def filedesc(version: int, date: str) -> bytes:
    """The record that opens an ARC file."""
    names = (
        "URL IP-address Archive-date Content-type Archive-length" if version == 1 else
        "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    )
    body = f"{version} 0 inkwell\n{names}\n".encode()
    head = f"filedesc://pages.arc 0.0.0.0 {date} text/plain "
    if version == 2:
        head += "200 - - 0 pages.arc "
    return f"{head}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, body: bytes, offset: int = 0) -> bytes:
    """One ARC record; blanks and controls in a URL are percent-coded, as fields part at blanks."""
    url = quote(url, safe="%/:=&?~#+!$,;'@()*[]") or "-"
    middle = "" if version == 1 else f"200 {hashlib.md5(body).hexdigest()} - {offset} pages.arc "
    return f"{url} 0.0.0.0 {date} text/html {middle}{len(body)}\n".encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of every record after the filedesc. A header line that does not have the
    fields of the file's version, or a body shorter than declared, raises ValueError."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC: header line without an end")
        values = data[at:end].decode("latin-1").rstrip("\r").split(" ")
        length = int(values[-1])
        at = end + 1
        body = data[at : at + length]
        if len(body) != length:
            raise ValueError("ARC: body shorter than declared")
        at += length
        if values[0].startswith("filedesc://"):
            version = body.split(b" ", 1)[0]
            fields = {b"1": V1, b"2": V2}.get(version)
            if fields is None:
                raise ValueError(f"ARC: version {version!r} is unknown")
            continue
        if fields is None or len(values) != len(fields):
            raise ValueError("ARC: header line does not fit the version")
        yield dict(zip(fields, values, strict=True)), body


# --- WARC ----------------------------------------------------------------


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; without a head, all is payload."""
    if body.startswith(b"HTTP/"):
        at = body.find(b"\r\n\r\n")
        if at >= 0:
            return body[: at + 4], body[at + 4 :]
    return b"", body


def record_id(url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {digest}')}>"


def _date(value: str) -> str:
    """14 digits to an ISO instant; shorter ARC dates are filled with the first moment they name."""
    filled = value + "00000101000000"[len(value) :] if len(value) < 14 else value[:14]
    return datetime.strptime(filled, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(fields: dict[str, str], body: bytes, refers: dict[str, str] | None = None) -> bytes:
    """A WARC/1.1 record for an ARC record: identifier, instant, type and digests are synthesised.

    HTTP responses become `response` (or, with `refers`, a `revisit` that keeps the HTTP head and
    leaves the payload out), anything else `resource`. Each record is a gzip member of its own.
    """
    head, payload = _split_http(body)
    digest = hashlib.sha1(payload).digest()
    block = head if refers else body
    kind = "revisit" if refers else "response" if head else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {fields['url']}", f"WARC-Date: {_date(fields['date'])}",
        f"WARC-Record-ID: {record_id(fields['url'], fields['date'], digest.hex())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if fields.get("ip", "0.0.0.0") != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {fields['ip']}")
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", *(f"{k}: {v}" for k, v in refers.items())]
    lines += [
        "Content-Type: " + ("application/http; msgtype=response" if head else fields["type"]),
        f"Content-Length: {len(block)}", "", "",
    ]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 1, mtime=0)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of a file of gzip members."""
    place = 0
    while place < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof and place < len(data):  # in steps, so that what follows a member is not copied each time
            step = data[place : place + STEP]
            parts.append(unpacker.decompress(step))
            place += len(step)
        place -= len(unpacker.unused_data)
        record = b"".join(parts)
        at = record.index(b"\r\n\r\n")
        lines = record[:at].decode().split("\r\n")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        yield headers, record[at + 4 : at + 4 + int(headers["content-length"])]


# --- Spark ---------------------------------------------------------------


def convert_arc(archives: DataFrame, folder: str) -> DataFrame:
    """ARC files, a row each (path, content), to WARC files in `folder`: (path, n_records).
    Rows may come from Spark's binaryFile source; every file is converted on its own."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                records = [warc_record(f, b) for f, b in read_arc(content)]
                to = f"{folder}/{hashlib.sha1(path.encode()).hexdigest()[:16]}.warc.gz"
                write_whole(to, b"".join(records))
                yield pa.RecordBatch.from_pydict({"path": [to], "n_records": [len(records)]})

    return archives.select("path", "content").mapInArrow(run, "path string, n_records long")


def _page_http(page_id: int | None, payload_size: int) -> bytes:
    return (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n"
        f"Content-Length: {payload_size}\r\n\r\n"
    ).encode()


def _page_date(page_id: int | None) -> str:
    return (datetime(2000, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(page_id or 0) % (1 << 29))).strftime("%Y%m%d%H%M%S")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages to legacy ARC records, and those through the converter into WARC files of bounded size.

    Returns the list of files (path, n_records). Payloads are the html in UTF-8, empty where
    null. Of equal payloads of at least MIN_REVISIT bytes the record of the largest page_id is
    the response and the others revisit it. Digests are summed up before the join, and only
    digests that occur twice are joined back, by a join that Spark splits where one payload is
    very common. Pages of even ids go through version 1 records, odd ones through version 2.
    Null page_ids are kept and are never the largest; repeated rows of the largest page_id are
    all responses.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(
        "page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body")
    ).withColumn("digest", F.when(F.length("body") >= MIN_REVISIT, F.sha1("body")))
    twice = (
        rows.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    # pages without a digest have no partner: they stay where they are, instead of meeting under one null key
    alone = rows.where("digest IS NULL").select("page_id", "url", "body", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    marked = rows.where("digest IS NOT NULL").join(twice, "digest", "left").select("page_id", "url", "body", "first_id", "first_url").unionByName(alone)

    def run(batches):
        records, size, done = [], 0, []

        def close():
            nonlocal records, size
            if records:
                to = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                write_whole(to, b"".join(records))
                done.append((to, len(records)))
            records, size = [], 0

        for batch in batches:
            for page_id, url, body, first_id, first_url in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                version = 1 if page_id is None or page_id % 2 == 0 else 2
                opening = filedesc(version, _page_date(page_id))
                arc = opening + arc_record(version, url, _page_date(page_id), _page_http(page_id, len(body)) + body, size)
                for fields, record in read_arc(arc):
                    refers = None
                    if first_id is not None and page_id != first_id:
                        target = next(read_arc(filedesc(1, _page_date(first_id)) + arc_record(1, first_url, _page_date(first_id), b"")))[0]
                        digest = hashlib.sha1(body).hexdigest()
                        refers = {
                            "WARC-Refers-To": record_id(target["url"], target["date"], digest),
                            "WARC-Refers-To-Target-URI": target["url"], "WARC-Refers-To-Date": _date(target["date"]),
                            "X-Refers-To-Page": str(first_id),
                        }
                    records.append(warc_record(fields, record, refers))
                    size += len(records[-1])
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"]
        )

    return staged(marked.mapInArrow(run, "path string, n_records long"), "warc-list")


HEAD_FIELD = re.compile(rb"(?im)^(x-page-id|content-length): *([^\r\n]*)")


def read_archives(files: DataFrame) -> DataFrame:
    """Read listed WARC files back: a row per record with its type, digest, sizes and payload
    (null for revisits)."""

    def some(rows: list[tuple]) -> Iterable[pa.RecordBatch]:
        if rows:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "payload")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_warc(read_whole(path)):
                    head, payload = _split_http(block)
                    fields = {k.lower(): v for k, v in HEAD_FIELD.findall(head)}
                    page, refers = fields.get(b"x-page-id"), headers.get("x-refers-to-page")
                    revisit = headers["warc-type"] == "revisit"
                    digest = base64.b32decode(headers["warc-payload-digest"].split(":", 1)[1]).hex()
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"WARC: payload of {headers['warc-record-id']} does not match its digest")
                    rows.append((
                        int(page) if page else None, headers["warc-target-uri"], headers["warc-type"],
                        int(fields[b"content-length"]) if revisit else len(payload), digest,
                        int(refers) if refers else None, headers["warc-record-id"], None if revisit else payload,
                    ))
                    if len(rows) == 256:
                        yield from some(rows)
                        rows = []
                yield from some(rows)

    spread = files.select("path").repartition(width(files.sparkSession), "path")
    return spread.mapInArrow(
        run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary"
    )
