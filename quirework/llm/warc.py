"""Legacy archive converter: ARC files (version 1 and 2) to WARC, with revisit records for equal payloads, and a WARC reader.

An ARC file starts with a version block, whose second line names the header fields of every record: five in version 1,
ten in version 2. Records are cut by the length that their header declares, never by searching for the next header, so
payloads may hold anything. What ARC lacks is synthesised: record identifiers (UUID 5 over file, place, target, date and
digest), ISO timestamps from the 14-digit dates, record types from scheme and content, and SHA-1 digests in base32.

Archives are read by Spark's binaryFile source and inflated as a stream: a task holds one archive as it is stored, and
one record. They are written by Spark's text writer into a folder that Spark can reach, a gzip member for each record,
in files that end at the first record past a number of bytes: nothing needs a local file system.

Defined results: a null url becomes ``-``, white space and controls in urls are percent-encoded; a null html is an
empty payload; a null page_id leaves the record without one. Repeated page rows each get a record with an identifier of
its own. A payload of any length is one record. A header line is read from its date, so that spaces in the url or the
content type do no harm; one that fits neither version but ends in a number has its declared length skipped, and any
other is passed over. A record whose declared length passes the end of the file, or whose file is cut off, keeps what is
there and is marked ``WARC-Truncated: length``. A WARC record without a digest, a page or a known header line is read
with nulls. Empty tables give archives without records. Further columns of pages are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the ARC format: the fields of a record's header line by version.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: A header line around its date, the only field of digits alone in front of the status or length.
ARC_LINES = {"1": re.compile(r"(.*) (\S+) ([0-9]{4,17}) (.*) ([0-9]+)"), "2": re.compile(r"(.*) (\S+) ([0-9]{4,17}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) ([0-9]+)")}
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRLF = "\r\n"

ARCS = "path string, content binary"
RECORDS = "record_id string, warc_type string, warc_date string, target_uri string, ip string, content_type string, head binary, payload binary, payload_bytes long, payload_digest string, truncated boolean"
READ = "record_id string, warc_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, intact boolean"
#: Bytes after which a batch is handed on.
BATCH_BYTES = 4 << 20
#: Bytes that are inflated at a time.
PIECE = 1 << 16
#: Stored bytes after which a written archive ends.
FILE_BYTES = 32 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def inflated(data: bytes) -> io.BufferedReader:
    """The content as a stream that ends where a cut-off gzip file does; members follow each other."""
    if data[:2] != b"\x1f\x8b":
        return io.BufferedReader(io.BytesIO(data))

    class Members(io.RawIOBase):
        at, unit = 0, zlib.decompressobj(31)

        def readable(self) -> bool:
            return True

        def readinto(self, room) -> int:
            while self.at < len(data) or self.unit.unconsumed_tail:
                if self.unit.eof:
                    # Zeros may pad the space between members; anything else is no member.
                    start = data.find(b"\x1f\x8b", self.at)
                    if start < 0 or data[self.at : start].strip(b"\0"):
                        return 0
                    self.at, self.unit = start, zlib.decompressobj(31)
                given = self.unit.unconsumed_tail
                if not given:
                    given = data[self.at : self.at + PIECE]
                    self.at += len(given)
                try:
                    out = self.unit.decompress(given, len(room))
                except zlib.error:
                    self.at, self.unit = len(data), zlib.decompressobj(31)
                    return 0
                self.at -= len(self.unit.unused_data)
                if out:
                    room[: len(out)] = out
                    return len(out)
            return 0

    return io.BufferedReader(Members(), PIECE)


def read_upto(stream: io.BufferedReader, n: int) -> bytes:
    """n bytes, or what is left; a wrong length takes no memory."""
    parts = []
    while n > 0 and (part := stream.read(min(n, 1 << 20))):
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def arc_header(version: str, **values: str) -> bytes:
    return " ".join(values.get(f.replace("-", "_"), "-") for f in ARC_FIELDS[version]).encode() + b"\n"


def arc_file(name: str, version: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC file of (url, 14-digit date, content) records."""
    block = f"{version} 0 quirework\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    parts = [arc_header(version, URL=f"filedesc://{name}", IP_address="0.0.0.0", Archive_date="20200101000000", Content_type="text/plain", Archive_length=str(len(block))), block]
    for url, date, content in records:
        parts += [arc_header(version, URL=url, IP_address="127.0.0.1", Archive_date=date, Content_type="text/html", Result_code="200", Filename=name, Archive_length=str(len(content))), content, b"\n"]
    return b"".join(parts)


def arc_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def pages_to_arcs(pages: DataFrame, per_file: int = 64) -> DataFrame:
    """ARC files of at most per_file records, as path and content: pages as an old crawler would have left them, versions taking turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, urls, htmls = (batch.column(c) for c in ("page_id", "url", "html"))
            for at in range(0, batch.num_rows, per_file):
                records = []
                for i in range(at, min(at + per_file, batch.num_rows)):
                    body, page = htmls[i].as_py() or b"", ids[i].as_py()
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + f"Content-Length: {len(body)}\r\n\r\n"
                    records.append((arc_url(urls[i].as_py()), "20200101000000", head.encode() + body))
                name = f"pages-{part:05d}-{n:06d}.arc"
                yield pa.RecordBatch.from_pydict({"path": [name], "content": [arc_file(name, "12"[n % 2], records)]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))
                n += 1

    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, ARCS)


def arc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields, content, truncated) of each record behind the version block."""
    version = "1"
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        last = text.rpartition(" ")[2]
        length = int(last) if re.fullmatch(r"[0-9]{1,18}", last) else 0
        content = read_upto(stream, length)
        if text.startswith("filedesc://"):
            # The version block's first word is the version of all that follows.
            word = content.split(b" ", 1)[0].decode("utf-8", "replace")
            version = word if word in ARC_LINES else version
        elif m := ARC_LINES[version].fullmatch(text):
            yield dict(zip(ARC_FIELDS[version], m.groups(), strict=True)), content, len(content) < length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and body; no head if it isn't an HTTP response."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def warc_date(date: str) -> str:
    """Missing digits are those of the first moment of the time that is given."""
    d = date[:14] + "19700101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert_arcs(arcs: DataFrame) -> DataFrame:
    """A row for each WARC record to write. arcs: path and content, as the binaryFile source gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("ip", pa.string()), ("content_type", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("truncated", pa.bool_())])
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for number, (h, block, truncated) in enumerate(arc_records(inflated(content.as_py() or b""))):
                    head, body = split_http(block)
                    digest, url, date = base32_sha1(body), h["URL"], warc_date(h["Archive-date"])
                    kind = "response" if head else "resource"
                    rid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((path.as_py() or '', str(number), url, date, digest)))}"
                    rows.append((rid, kind, date, url, h["IP-address"], "application/http; msgtype=response" if head else h["Content-type"], head, body, len(body), digest, truncated))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return arcs.select("path", "content").mapInArrow(run, RECORDS)


def with_revisits(records: DataFrame, top_by: str, groups: DataFrame) -> DataFrame:
    """Adds refers_to (top_by of the response) and refers_to_id; both null for responses. groups: repeated_payloads' table.

    Joined by digest to the groups of more than one record only, from a written table, so that a payload that many
    records share is split or broadcast, not sent to one task.
    """
    lower = (F.col(top_by) < F.col("top." + top_by)) | (F.col(top_by).isNull() & F.col("top." + top_by).isNotNull())
    joined = records.join(groups, "payload_digest", "left")
    return joined.withColumns({"refers_to": F.when(lower, F.col("top." + top_by)), "refers_to_id": F.when(lower, F.col("top.record_id"))}).drop("top")


def repeated_payloads(records: DataFrame, top_by: str, least_bytes: int = 0) -> DataFrame:
    """payload_digest and top (the record with the greatest top_by) of payloads of least_bytes or more that several records have."""
    found = records.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct(top_by, "record_id")).alias("top"), F.count("*").alias("n"))
    return found.filter("n > 1").drop("n")


def warc_record(page_id: Column) -> Column:
    """The bytes of a whole WARC record."""
    revisit = F.col("refers_to_id").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("warc_type"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_id", F.lit(">"))),
        line("WARC-Truncated", F.when(F.col("truncated"), "length")),
        line("X-Page-Id", page_id.cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.length(block).cast("string")),
        F.lit(CRLF),
    )
    return F.concat(head.cast("binary"), block, F.lit(CRLF + CRLF).cast("binary"))


def gzip_member(data: bytes) -> bytes:
    """data as a gzip member whose last byte is zero. The last byte is the highest of the length: from 16 MB on an empty member follows."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if not out[-1] else out + gzip_member(b"")


def write_warcs(records: DataFrame, page_id: Column, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Archives in the folder path, each ending at the first record past file_bytes.

    An archive is one line of the text writer, which ends lines by a zero byte: the last byte of the last member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                held.append(gzip_member(record.as_py()))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    files = records.select(warc_record(page_id).alias("value")).mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, cut by Content-Length; names in lower case. What stands between records is passed over."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        header: dict[str, str] = {}
        while (line := stream.readline()) not in (b"", b"\n", CRLF.encode()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.strip().lower()] = value.strip()
        length = header.get("content-length", "")
        yield header, read_upto(stream, int(length)) if re.fullmatch(r"[0-9]{1,18}", length) else b""


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the gzipped or plain WARC files in the folder; intact: block and payload have the declared lengths and digest, where declared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        number = lambda x: int(x) if re.fullmatch(r"-?[0-9]{1,18}", x or "") else None
        rows = []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for content in batch.column("content"):
                for h, block in warc_records(inflated(content.as_py() or b"")):
                    kind, declared = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    digest, n, intact = declared, number(h.get("x-payload-length")), len(block) == number(h.get("content-length"))
                    if kind != "revisit":
                        body = split_http(block)[1]
                        digest = base32_sha1(body)
                        intact = intact and n in (None, len(body)) and declared in (None, digest)
                        n = len(body)
                    rows.append((h.get("warc-record-id", "").strip("<>") or None, kind, h.get("warc-target-uri"), number(h.get("x-page-id")), n, digest, number(h.get("x-refers-to-page-id")), intact))
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)
