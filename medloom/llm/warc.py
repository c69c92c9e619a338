"""Legacy archive converter: ARC files of version 1 and 2 into WARC 1.1 records, written and read by Spark.

An ARC file opens with a version block whose second line names the version and whose third lists the fields of each
record's header line; version 1 has five, version 2 adds result code, checksum, location, offset and file name. The
declared length at the end of the line alone says where a record ends. A WARC record needs what ARC lacks: an identifier
(here a name-based UUID of what identifies the capture and of its place in its ARC file, so equal captures have their own), an ISO date, a type, and digests.

Equal payloads of at least `least` bytes become one response and revisits of it. The response is the one with the
largest page id; rows that share that id are all responses, and so are all rows of a group without ids. The groups
are formed on digests only (an aggregate with map-side combining, one row a digest), and a digest that a third of all
records share makes a skewed join, which Spark splits.

WARC files are written by Spark's text writer with CRLF CRLF, the WARC record separator, between records, so any file
system that Spark reaches will do; they are gzip files of at most `per_file` records. Reading takes whole files and
steps through them by the declared lengths, checking every digest.

Cases: a null html is an empty payload; a null or empty url becomes urn:no-url, other urls are percent-encoded where they
hold white space or control characters; null and repeated page ids and repeated rows keep their own records; an empty
table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm.common import shared_dir

# Field lists of the two versions of ARC header lines, the page's own header, WARC's record separator, and
# the URI that marks a revisit of an identical payload.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_HEADER, CRLF = b"X-Page-Id", b"\r\n"
SEPARATOR = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
LEAST, PER_FILE, FILE_BYTES, ARC_BYTES, CAPTURED = 1000, 4096, 64 << 20, 8 << 20, "20000101000000"


# --- ARC ------------------------------------------------------------------------------------------------------------


def _arc_line(version: int, uri: bytes, date: str, kind: str, name: str, offset: int, length: int) -> bytes:
    middle = b"" if version == 1 else f" 200 - - {offset} {name}".encode()
    return uri + f" 0.0.0.0 {date} {kind}".encode() + middle + f" {length}\n".encode()


def arc_file(name: str, version: int, records: list[tuple[bytes, str, str, bytes]]) -> bytes:
    """An ARC file of (uri, 14-digit date, media type, content) records."""
    about = f"{version} 0 medloom\n{FIELDS[version]}\n".encode()
    out = bytearray(_arc_line(version, f"filedesc://{name}".encode(), CAPTURED, "text/plain", name, 0, len(about)) + about)
    for uri, date, kind, content in records:
        out += b"\n"
        out += _arc_line(version, uri, date, kind, name, len(out), len(content)) + content
    out += b"\n"
    return bytes(out)


def arc_records(data: bytes) -> Iterator[dict[str, bytes]]:
    """The records of an ARC file after its version block: fields of the header line by name, and `content`.

    Raises ValueError where the file is cut short, the version is unknown or a header line has other fields than named.
    """
    end = data.index(b"\n")
    about_end = end + 1 + int(data[:end].rsplit(b" ", 1)[1])
    lines = data[end + 1 : about_end].split(b"\n")
    if int(lines[0].split(b" ", 1)[0]) not in FIELDS:
        raise ValueError(f"unknown ARC version: {lines[0][:40]!r}")
    names, at = lines[1].decode().split(" "), about_end
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        values = data[at:end].split(b" ") if end >= 0 else []
        if len(values) != len(names):
            raise ValueError(f"ARC header line at {at} has {len(values)} fields instead of {len(names)}")
        found = dict(zip(names, values, strict=True))
        start, at = end + 1, end + 1 + int(found["Archive-length"])
        if at > len(data):
            raise ValueError(f"ARC record at {start} declares more bytes than there are")
        yield found | {"content": data[start:at]}


def _to_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html) as ARC files, versions in turn, of 256 pages or, where pages are long, ARC_BYTES on average."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, urls, pages = (batch.column(0), *(batch.column(i).cast(pa.binary()) for i in (1, 2)))
        step = max(1, min(256, batch.num_rows * ARC_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            records = []
            for i in range(at, min(at + step, batch.num_rows)):
                html, key = pages[i].as_py() or b"", ids[i].as_py()
                uri = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], urls[i].as_py() or b"urn:no-url")
                page = b"" if key is None else PAGE_HEADER + f": {key}".encode() + CRLF
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + page
                records.append((uri, CAPTURED, "text/html", head + f"Content-Length: {len(html)}\r\n\r\n".encode() + html))
            name = f"pages-{part:06d}-{made:06d}.arc"
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([arc_file(name, 1 + made % 2, records)], pa.binary())], names=["name", "content"]
            )
            made += 1


# --- conversion -----------------------------------------------------------------------------------------------------

LIGHT = "page_id long, record_id string, payload_digest string, payload_bytes long"
RECORD = LIGHT + ", uri string, date string, block binary"


def _header(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(CRLF):
        key, colon, value = line.partition(b":")
        if colon and key.lower() == name.lower():
            return value.strip()
    return None


def _converted(light: bool):
    """ARC files (name, content) as the WARC records that they become; light: without their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                for place, r in enumerate(arc_records(content.as_py())):
                    head, _, payload = r["content"].partition(CRLF + CRLF)
                    page, digest = _header(head, PAGE_HEADER), hashlib.sha1(payload).hexdigest()
                    d, uri = r["Archive-date"].decode(), r["URL"].decode("utf-8", "replace")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    name = f"{uri}\n{date}\n{digest}\n{page}\n{file}\n{place}"
                    row = (None if page is None else int(page), f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", digest, len(payload))
                    rows.append(row if light else (*row, uri, date, r["content"]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.string(), pa.binary()] * (not light)
                names = [x.split(" ")[0] for x in (LIGHT if light else RECORD).split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows
                    else [pa.array([], k) for k in kinds], names=names,
                )

    return run


def convert(arcs: DataFrame, least: int = LEAST) -> DataFrame:
    """WARC records of ARC files (name, content): identifiers, dates, digests, and for revisits what they refer to."""
    light = arcs.mapInArrow(_converted(True), LIGHT).where(F.col("payload_bytes") >= least)
    first = F.max(F.struct("page_id", "record_id")).alias("first")
    groups = light.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("many"), first)
    groups = groups.where("many > 1 and first.page_id is not null")
    rows = arcs.mapInArrow(_converted(False), RECORD)
    rows = rows.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first.page_id")))
    return rows.select(
        *[x.split(" ")[0] for x in RECORD.split(", ")], F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.record_id")).alias("refers_id"), F.when(revisit, F.col("first.page_id")).alias("refers_to"),
    )


# --- WARC -----------------------------------------------------------------------------------------------------------


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(r: dict) -> bytes:
    """One WARC record, without the separator that follows it."""
    block = r["block"]
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]),
              ("WARC-Target-URI", r["uri"]), ("WARC-Payload-Digest", f"sha1:{_base32(r['payload_digest'])}")]
    if r["record_type"] == "revisit":
        block = block[: block.index(CRLF + CRLF) + 4]
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{r['refers_id']}>"),
                   ("X-Refers-To-Page-Id", r["refers_to"]), ("X-Payload-Length", r["payload_bytes"])]
    fields += [("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF + block


def _serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            records = pa.array([warc_record(r) for r in batch.slice(at, 512).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([records.cast(pa.string())], names=["value"])


def write_warc(records: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Writes records as gzip WARC files under a path."""
    lines = records.mapInArrow(_serialised, "value string")
    options = {"lineSep": SEPARATOR, "compression": "gzip", "maxRecordsPerFile": per_file, "zlib.compress.level": "BEST_SPEED"}
    lines.write.options(**options).text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of a WARC file; raises ValueError on a damaged one."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at {at}")
        end = data.index(CRLF + CRLF, at)
        pairs = (line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in pairs}
        start, at = end + 4, end + 4 + int(fields["content-length"])
        if data[at : at + 4] != CRLF + CRLF:
            raise ValueError(f"WARC record at {start} does not end where it declares")
        yield fields, data[start:at]
        at += 4


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = {"page_id": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": [], "record_id": []}
            for fields, block in warc_records(gzip.decompress(content.as_py())):
                head, _, payload = block.partition(CRLF + CRLF)
                page, stated = _header(head, PAGE_HEADER), base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                revisit = fields["warc-type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                rows["page_id"].append(None if page is None else int(page))
                rows["payload_bytes"].append(int(fields["x-payload-length"]) if revisit else len(payload))
                rows["payload_digest"].append(stated)
                rows["record_type"].append(fields["warc-type"])
                rows["refers_to"].append(int(fields["x-refers-to-page-id"]) if revisit else None)
                rows["record_id"].append(fields["warc-record-id"].strip("<>"))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the WARC files under a path: what a revisit's payload was is taken from its fields."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
    return files.mapInArrow(_read_back, schema)


def archive_pages(pages: DataFrame, least: int = LEAST, per_file: int | None = None) -> DataFrame:
    """Pages (page_id, url, html) through ARC files into WARC files in the shared folder, and what reading them gives.

    Without per_file, files get as many records as make FILE_BYTES on average, PER_FILE at most.
    """
    spark = pages.sparkSession
    if per_file is None:
        many, size = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
        per_file = max(1, min(PER_FILE, many * FILE_BYTES // max(1, size or 0)))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    arcs = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_to_arcs, "name string, content binary")
    write_warc(convert(arcs, least), path, per_file)
    return read_warc(spark, path)
