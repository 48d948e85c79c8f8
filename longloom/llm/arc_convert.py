"""Legacy ARC archives to WARC, with revisit records for repeated payloads.

**Reading ARC.**  A file starts with a ``filedesc://`` record whose body names the version; version 1
headers have 5 blank-separated fields, version 2 headers have 10, the last one is always the
declared length of the block.  Headers are cut from the right, so a URL that holds blanks survives.
Blocks are taken by their declared length, never by searching for a separator.  Plain files, one
gzip stream or one gzip member per record are all read as a stream.

**Writing WARC.**  Identifiers are name-based UUIDs of (URL, date, address, page, payload digest), so
a lost task writes the same record again; 14-digit dates become ISO timestamps; HTTP blocks become
``response`` (others ``resource``) records with payload and block digests (``sha1:`` + base32).
Records with equal payloads of at least ``min_revisit`` bytes: the one with the largest page_id is the
response, the others become ``revisit`` records that keep the HTTP headers and name the response.

**Spark.**  Archives are written by Spark's text writer (record separators are the line separator of
the format, ``maxRecordsPerFile`` bounds a file, the gzip codec compresses it), so the commit
protocol makes lost executors harmless, and any store Spark can reach will do.  They are read with
the binary-file source, one bounded file at a time, decompressed piecewise.  Payloads move between
tasks at most once, keyed by the record identifier; who revisits whom is decided on digests.

Edge cases.  A null html is an empty payload; a null url is written as ``-``; white space and control
characters of a url are percent-encoded.  A null page_id has no page header and reads back as null;
it revisits any equal payload with a page_id.  Repeated rows with the largest page_id are all
responses.  A truncated last block is dropped; lines that are no header are skipped.  Extra columns
are ignored; an empty table gives archives without records and an empty result.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, scratch_path

RECORDS_PER_FILE = 1024
FILE_BYTES = 1 << 30             # of payloads in a file at most: a file is read as one row
MIN_REVISIT = 1000
CHUNK = 1 << 20
FLUSH_BYTES = 4 << 20

# fixed values of the two archive formats
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

META = "page_id long, record_id string, url string, date string, digest string, payload_bytes long"
RECORD = META + ", ip string, mime string, kind string, http binary, payload binary"
WARC_ROW = ("page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, "
            "refers_to_id string")


# ---- streams ----------------------------------------------------------------------------------

def inflate(content):
    """Pieces of a plain or gzip-compressed (one or many members) byte string."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        for i in range(0, len(view), CHUNK):
            yield bytes(view[i: i + CHUNK])
        return
    z, at = zlib.decompressobj(31), 0
    pending = b""
    while True:
        data = pending or bytes(view[at: at + CHUNK])
        if not pending:
            at += CHUNK
        pending = b""
        if not data:
            return
        out = z.decompress(data, CHUNK)
        if out:
            yield out
        if z.eof:
            pending = z.unused_data
            z = zlib.decompressobj(31)
        else:
            pending = z.unconsumed_tail


class Stream:
    """Lines and counted blocks from byte pieces; holds one piece and the block being read."""

    def __init__(self, pieces):
        self.pieces, self.buf, self.at = iter(pieces), b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buf, self.at = self.buf[self.at:] + piece, 0
        return True

    def line(self):
        """The next line without its end, or None at the end."""
        while True:
            i = self.buf.find(b"\n", self.at)
            if i >= 0:
                out = self.buf[self.at: i]
                self.at = i + 1
                return out[:-1] if out.endswith(b"\r") else out
            if not self._more():
                out, self.at = self.buf[self.at:], len(self.buf)
                return out or None

    def take(self, n: int):
        """Exactly ``n`` bytes, or None when the stream ends before."""
        parts, need = [], n
        while need:
            if self.at >= len(self.buf) and not self._more():
                return None
            part = self.buf[self.at: self.at + need]
            self.at += len(part)
            need -= len(part)
            parts.append(part)
        return b"".join(parts)


# ---- ARC --------------------------------------------------------------------------------------

def number(value) -> int | None:
    """A decimal number of a header (64 bits), or None for anything else."""
    value = value if isinstance(value, str) or value is None else bytes(value).decode("latin-1")
    if value is None or not re.fullmatch(r"\s*-?[0-9]{1,18}\s*", value):
        return None
    return int(value)


def arc_header(line: bytes, version: int):
    """``(url, ip, date, mime, length)`` of a header line of that version, or None."""
    parts = line.rsplit(b" ", 4 if version == 1 else 9)
    if len(parts) != (5 if version == 1 else 10) or not parts[-1].isdigit() or len(parts[2]) != 14 \
            or not parts[2].isdigit():
        return None
    return (*(p.decode("utf-8", "replace") for p in parts[:4]), int(parts[-1]))


def arc_records(content):
    """``(url, ip, date, mime, block)`` of every record of an archive but its file description."""
    s = Stream(inflate(content))
    version = None
    while (line := s.line()) is not None:
        if line.startswith(b"filedesc://"):
            tail = line.rsplit(b" ", 1)[-1]
            body = s.take(int(tail)) if tail.isdigit() else None
            if body is None:
                return
            version = 2 if body.lstrip().startswith(b"2") else 1
            continue
        if not line or version is None:
            continue
        head = arc_header(line, version)
        if head is None:
            continue
        block = s.take(head[4])
        if block is None:
            return
        yield (*head[:4], block)


def split_http(block: bytes):
    """HTTP head (with its blank line) and payload; a block without HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    i = block.find(b"\r\n\r\n")
    return (block, b"") if i < 0 else (block[: i + 4], block[i + 4:])


def http_field(head: bytes, name: bytes):
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip()
    return None


def _safe_url(url) -> str:
    if not url:
        return "-"
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode())
                   for c in url)


def _arc_writer(version_of, per_file: int, start: str):
    first = datetime.datetime.strptime(start, "%Y%m%d%H%M%S")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        version, n, files = version_of(part), 0, 0
        for rb in batches:
            out, size = [], 0
            for pid, url, html in zip(*(rb.column(i).to_pylist() for i in range(3))):
                if n % per_file == 0:
                    name = f"part-{part:05d}-{files:05d}.arc"
                    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n"
                    extra = "" if version == 1 else f"200 - - 0 {name} "
                    out.append(f"filedesc://{name} 0.0.0.0 {start} text/plain {extra}{len(body)}\n{body}".encode())
                    n, files = n + 1, files + 1
                payload = (html or "").encode()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
                if pid is not None:
                    head += "X-Page-Id: %d\r\n" % pid
                block = head.encode() + b"\r\n" + payload
                date = (first + datetime.timedelta(seconds=(pid or 0) % 100_000_000)).strftime("%Y%m%d%H%M%S")
                extra = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - 0 - "
                line = f"{_safe_url(url)} 0.0.0.0 {date} text/html {extra}{len(block)}\n"
                out.append(line.encode() + block)
                n, size = n + 1, size + len(block)
                if size > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    return run


def _write_text(rows: DataFrame, path: str, line_sep: str, per_file: int) -> None:
    """Rows of one binary column as files of records (binary to string is a reinterpretation)."""
    (rows.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", line_sep)
     .option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path))


def write_arc(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, start: str = "20080101000000") -> None:
    """Pages ``page_id, url, html`` as ARC archives; tasks alternate between versions 1 and 2."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = p.mapInArrow(_arc_writer(lambda part: 1 + part % 2, per_file, start), "value binary")
    _write_text(rows, path, "\n", per_file)


# ---- ARC -> WARC ------------------------------------------------------------------------------

def _arc_rows(with_payload: bool):
    def run(batches):
        import pyarrow as pa
        names = [f.split()[0] for f in (RECORD if with_payload else META).split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
                 pa.string(), pa.binary(), pa.binary()][: len(names)]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for rb in batches:
            for r in range(rb.num_rows):
                rows, size = [], 0
                for url, ip, date, mime, block in arc_records(rb.column(0)[r].as_buffer()):
                    head, payload = split_http(block)
                    pid = http_field(head, b"x-page-id")
                    pid = number(pid)
                    digest = hashlib.sha1(payload).hexdigest()
                    rid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {ip} {pid} {digest}"))
                    row = (pid, rid, url, date, digest, len(payload))
                    if with_payload:
                        row += (ip, mime, "response" if head else "resource", head, payload)
                        size += len(block)
                    rows.append(row)
                    if size > FLUSH_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)
    return run


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _iso(date: str) -> str:
    d = date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields, block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def _warc_writer(per_file: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, n, files = TaskContext.get().partitionId(), 0, 0
        for rb in batches:
            out, size = [], 0
            for (pid, rid, url, date, digest, _, ip, mime, kind, http, payload, to_id, to_url, to_date) in zip(
                    *(rb.column(i).to_pylist() for i in range(14))):
                if n % per_file == 0:
                    name = f"part-{part:05d}-{files:05d}.warc"
                    body = b"format: WARC File Format 1.0\r\nsoftware: archive converter\r\n"
                    out.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Date", _iso(date)), ("WARC-Filename", name),
                                            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                                            ("Content-Type", "application/warc-fields")], body))
                    n, files = n + 1, files + 1
                block = http if to_id else http + payload
                out.append(warc_record([
                    ("WARC-Type", "revisit" if to_id else kind), ("WARC-Record-ID", f"<urn:uuid:{rid}>"),
                    ("WARC-Date", _iso(date)), ("WARC-Target-URI", url), ("WARC-IP-Address", ip),
                    ("WARC-Payload-Digest", _base32(digest)),
                    ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())),
                    ("WARC-Profile", to_id and REVISIT_PROFILE), ("WARC-Refers-To", to_id and f"<urn:uuid:{to_id}>"),
                    ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", to_date and _iso(to_date)),
                    ("Content-Type", "application/http; msgtype=response" if http else mime)], block))
                n, size = n + 1, size + len(block)
                if size > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    return run


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT,
            per_file: int = RECORDS_PER_FILE) -> None:
    """Convert the ARC archives under ``arc_path`` into WARC archives under ``warc_path``."""
    meta = cut_lineage(read_archives(spark, arc_path).mapInArrow(_arc_rows(False), META), "arc-meta")
    large = meta.filter(F.col("payload_bytes") >= min_revisit)
    groups = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).filter(
        "c > 1 and top is not null").select("digest", "top")
    target = large.select("digest", F.col("page_id").alias("top"), F.col("record_id").alias("to_id"),
                          F.col("url").alias("to_url"), F.col("date").alias("to_date")).join(
        groups, ["digest", "top"]).dropDuplicates(["digest"])
    again = large.join(target, "digest").filter("page_id is null or page_id < top").select(
        "record_id", "to_id", "to_url", "to_date").dropDuplicates(["record_id"])
    again = cut_lineage(again, "arc-revisits")
    records = read_archives(spark, arc_path).mapInArrow(_arc_rows(True), RECORD)
    rows = records.join(again, "record_id", "left").select(*records.columns, "to_id", "to_url", "to_date")
    _write_text(rows.mapInArrow(_warc_writer(per_file), "value binary"), warc_path, "\r\n\r\n", per_file)


# ---- WARC -------------------------------------------------------------------------------------

def warc_records(content):
    """``(headers, block)`` of every record; header names in lower case."""
    s = Stream(inflate(content))
    while (line := s.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while line := s.line():
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = number(head.get("content-length", "0"))
        if size is None or size < 0:
            continue                                       # no length: go on at the next version line
        block = s.take(size)
        if block is None:
            return
        yield head, block


def _uuid(value):
    return value[len("<urn:uuid:"):-1] if value else None


def payload_digest(head) -> str | None:
    """Hex digest of a ``WARC-Payload-Digest`` header, None where it is missing or odd."""
    try:
        return base64.b32decode(head.get("warc-payload-digest", "")[5:]).hex() or None
    except ValueError:
        return None


def _warc_rows(batches):
    import pyarrow as pa
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in WARC_ROW.split(", ")]
    for rb in batches:
        for r in range(rb.num_rows):
            rows = []
            for head, block in warc_records(rb.column(0)[r].as_buffer()):
                kind = head.get("warc-type")
                if kind not in ("response", "resource", "revisit"):
                    continue
                http, payload = split_http(block)
                pid = http_field(http, b"x-page-id")
                if kind == "revisit":
                    n, digest = number(http_field(http, b"content-length")) or 0, payload_digest(head)
                else:
                    n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                rows.append((number(pid), _uuid(head.get("warc-record-id")), kind, n, digest,
                             _uuid(head.get("warc-refers-to"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all records; the digest
    of a revisit is the one it declares, ``refers_to`` the page of the record it names."""
    rows = cut_lineage(read_archives(spark, path).mapInArrow(_warc_rows, WARC_ROW), "warc-rows")
    named = rows.filter("refers_to_id is not null").select("refers_to_id").distinct()
    pages = rows.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(
        named, "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    # only revisits are joined: the others have no key and would meet in one task
    again = rows.filter("refers_to_id is not null").join(pages, "refers_to_id", "left")
    rest = rows.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return again.select(*columns).unionByName(rest.select(*columns))


def pages_through_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages as ARC archives, converted to WARC and read back (archives in the shared folder)."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 1
    per_file = max(1, min(RECORDS_PER_FILE, FILE_BYTES // longest))
    write_arc(pages, arc, per_file)
    convert(spark, arc, warc, min_revisit, per_file)
    return read_warc(spark, warc)
