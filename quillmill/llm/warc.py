"""Legacy archives: ARC in, WARC out.

``parse_arc`` reads ARC files of version 1 and 2: the version block names the
fields of the header lines that follow, each header line ends in the declared
length of its content. ``convert`` turns the records into WARC records, with
identifiers, timestamps, types and digests made up from what the ARC record
says. Payloads that were seen before become revisits.

Archives are written by Spark's text writer, which goes through the cluster's
file system. A row is a whole file of ARCHIVE_BYTES at most (or of one larger
record): a gzip member per record, warcinfo first. A member ends in the high
byte of its length, which is 0 below 16 MB; that byte is the writer's row
separator (a longer record is followed by an empty member, which ends in 0),
so the files are WARC files to the byte. Spark names them: part-*.txt. They
are read back with Spark's binary file reader and parsed as streams.

ARC and WARC files from elsewhere are sources, too (`read_arc`,
`convert_archives`, `scan_archives`): what can't be read goes to rejects with
path, offset and reason, and files above a number of bytes are rejected unread.

Whether a payload was seen before is decided before writing, by an aggregation
over digests; no payload group is collected. A record's id is made of payload,
url and page, so only rows that are equal in all three share one.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import small_batches

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Bytes of an archive, but for one that a single record fills.
ARCHIVE_BYTES = 32 << 20
#: Files above this many bytes are rejected unread: a file is one row of one task.
MAX_FILE_BYTES = 1 << 30
#: A gzip member without content; it ends in 0.
EMPTY_MEMBER = zlib.compress(b"", 6, 31)
#: Capture time of pages that come without one.
DATE = "20240101000000"

#: The fields of the header lines by version, and the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes


@dataclass
class WarcRecord:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"WARC/1.0\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def arc_url(url: str | None) -> str:
    """A url fit for a header line: blanks and controls percent-encoded; ``unknown:`` for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "") or "unknown:"


def arc_header(version: int, name: str = "pages.arc", date: str = DATE) -> bytes:
    block = f"{version} 0 quillmill\n{ARC_FIELDS[version]}\n".encode()
    tail = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, mime: str, content: bytes, offset: int = 0, date: str = DATE, name: str = "pages.arc") -> bytes:
    tail = f" 200 {hashlib.md5(content).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{arc_url(url)} 0.0.0.0 {date} {mime}{tail} {len(content)}\n".encode() + content + b"\n"


def parse_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC file (a binary stream), the version block first.

    A header line with a wrong number of fields or a length that is no number
    raises ValueError, as does content that ends early.
    """
    names = ARC_FIELDS[1].split(" ")
    first = True
    while True:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        if first and len(parts) == 10:
            names = ARC_FIELDS[2].split(" ")
        if len(parts) != len(names):
            raise ValueError(f"header line of {len(parts)} fields, {len(names)} declared")
        fields = dict(zip(names, parts))
        length = int(fields["Archive-length"])
        content = stream.read(length)
        if len(content) != length:
            raise ValueError(f"content of {len(content)} bytes, {length} declared")
        if first and parts[0].startswith("filedesc:"):
            # the version block declares the fields of what follows
            lines = content.decode("ascii", "replace").split("\n")
            if len(lines) > 1 and lines[1].strip():
                names = lines[1].strip().split(" ")
        first = False
        yield ArcRecord(fields, content)


def warc_date(date: str) -> str:
    """``YYYYMMDDhhmmss``, or shorter, as ISO-8601; missing parts are the earliest."""
    d = (date if date.isdigit() else DATE).ljust(14, "0")[:14]
    month, day = max(1, int(d[4:6])), max(1, int(d[6:8]))
    return f"{d[:4]}-{month:02d}-{day:02d}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(digest: str, page_id: int | None, url: str = "") -> str:
    """A version 8 uuid of a payload's digest, a url and a page: the page can be read from it."""
    seed = hashlib.sha256(f"{digest} {url}".encode("utf-8", "surrogatepass")).hexdigest()
    number = 0 if page_id is None else page_id & (2**64 - 1)
    a = int(seed[:12], 16)
    b = (int(seed[12:15], 16) & 0x1FF) << 3 | (page_id is None) << 2 | number >> 62
    c = 0b10 << 62 | number & (2**62 - 1)
    h = f"{a:012x}8{b:03x}{c:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(urn: str | None) -> int | None:
    """The page that a record id names."""
    if not urn:
        return None
    h = urn.split(":")[-1].rstrip(">").replace("-", "")
    b, c = int(h[13:16], 16), int(h[16:], 16)
    if b & 4:
        return None
    number = (b & 3) << 62 | c & (2**62 - 1)
    return number - 2**64 if number >> 63 else number


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """Head (with the empty line) and payload of an HTTP response; None if it is none."""
    if not content.startswith(b"HTTP/"):
        return None
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = content.find(mark)
        if at >= 0:
            return content[: at + len(mark)], content[at + len(mark) :]
    return content, b""


def http_header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m.group(1).decode("utf-8", "replace") if m else None


def convert(arc: ArcRecord, refers_to: tuple[int, str] | None = None, digest: str | None = None, place: str = "") -> WarcRecord:
    """The WARC record equivalent to an ARC record.

    Version blocks become warcinfo, HTTP responses response, or revisit if
    ``refers_to`` names the page, and its url, whose payload they repeat;
    anything else (dns and the like) becomes resource. ``digest``: of the
    payload, if known. ``place``: what tells records without a page apart (file and offset).
    """
    date = warc_date(arc.fields.get("Archive-date", ""))
    url = arc.fields["URL"]
    if url.startswith("filedesc:"):
        urn = record_id(hashlib.sha256(arc.content).hexdigest(), None, f"{url} {place}")
        return WarcRecord([("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn), ("WARC-Date", date), ("WARC-Filename", url.partition("://")[2]), ("Content-Type", "application/warc-fields")], b"software: quillmill\r\nformat: WARC File Format 1.0\r\n")
    http = split_http(arc.content)
    head, payload = http or (b"", arc.content)
    page = http_header(head, b"X-Page-Id") if http else None
    page_id = int(page) if page and re.fullmatch(r"-?[0-9]{1,19}", page) else None
    digest = digest or hashlib.sha256(payload).hexdigest()
    common = [("WARC-Record-ID", record_id(digest, page_id, f"{url} {place}" if place else url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    ip = arc.fields.get("IP-address", "")
    if ip not in ("", "0.0.0.0", "-"):
        common.append(("WARC-IP-Address", ip))
    if http is None:
        return WarcRecord([("WARC-Type", "resource"), *common, ("Content-Type", arc.fields.get("Content-type") or "application/octet-stream")], payload)
    common.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is not None:
        return WarcRecord([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(digest, *refers_to))], head)
    return WarcRecord([("WARC-Type", "response"), *common], arc.content)


def parse_warc(stream) -> Iterator[WarcRecord]:
    """Records of a WARC file (a binary stream). A record that ends early raises ValueError."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers, length = [], 0
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            if name.lower() == "content-length":
                length = int(value)
            else:
                headers.append((name, value.strip()))
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"block of {len(block)} bytes, {length} declared")
        yield WarcRecord(headers, block)


def member(record: WarcRecord) -> bytes:
    """A record as a gzip member that ends in 0."""
    data = record.to_bytes()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out.endswith(b"\0") else out + EMPTY_MEMBER


class _Files:
    """Members until they fill a file; each file begins with the warcinfo record that is asked for."""

    def __init__(self, limit: int, info):
        self.limit, self.info, self.members, self.size, self.count = limit, info, [], 0, 0

    def add(self, one: bytes) -> Iterator[bytes]:
        if self.members and self.size + len(one) > self.limit:
            yield from self.flush()
        if not self.members:
            first = member(self.info(self.count))
            self.count += 1
            self.members, self.size = [first], len(first)
        self.members.append(one)
        self.size += len(one)

    def flush(self) -> Iterator[bytes]:
        if self.members:
            yield b"".join(self.members)[:-1]  # the last byte, 0, is the writer's separator
        self.members, self.size = [], 0


def _file_batch(files: list[bytes]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(files, pa.large_binary())], names=["file"])


def _convert_batches(limit: int):
    """Pages (page_id, url, html, digest, refers_to, refers_url) as an ARC file per batch, of either version in turn, converted record by record into WARC files."""

    def run(batches):
        seen = hashlib.sha256()  # over what went before, so that no two files of a run have the same warcinfo
        files = None
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            version = 1 + number % 2
            pages = batch.to_pydict()
            arc = io.BytesIO()
            arc.write(arc_header(version))
            for page_id, url, html in zip(pages["page_id"], pages["url"], pages["html"]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(payload)}\r\n\r\n"
                arc.write(arc_record(version, url, "text/html", head.encode() + payload, arc.tell()))
            arc.seek(0)
            records = parse_arc(arc)
            block = next(records)
            if files is None:
                files = _Files(limit, lambda k: convert(block, place=f"{seen.hexdigest()} {k}"))
            for record, digest, refers_to, refers_url in zip(records, pages["digest"], pages["refers_to"], pages["refers_url"]):
                one = convert(record, None if refers_to is None else (refers_to, arc_url(refers_url)), digest)
                seen.update(one.get("WARC-Record-ID").encode())
                for done in files.add(member(one)):
                    yield _file_batch([done])
        for done in files.flush() if files else ():
            yield _file_batch([done])

    return run


def _save(files: DataFrame, path: str) -> None:
    # the text writer puts bytes out as they are
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``.

    Of equal payloads of ``revisit_bytes`` or more, the one with the smallest
    page_id is the response (of its repeated rows, the ones with any url; the
    smallest url is the one that revisits name). Null ids are never the
    smallest; payloads that only pages without id have are all responses. Rows
    that repeat the smallest id are responses, too.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = small_batches(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    large = rows.filter(F.octet_length("html") >= revisit_bytes).select("page_id", "digest", F.coalesce("url", F.lit("")).alias("url"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    firsts = large.groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    again = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id")), F.col("first"))
    marked = rows.join(firsts, "digest", "left").withColumn("again", again).select("page_id", "url", "html", "digest", F.col("again.page_id").alias("refers_to"), F.col("again.url").alias("refers_url"))
    _save(marked.mapInArrow(_convert_batches(archive_bytes), "file binary"), path)


class _Unzipped(io.RawIOBase):
    """A gzip file in memory as a stream; members follow each other."""

    def __init__(self, data):
        self.data, self.at, self.z, self.rest = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while not self.rest:
            if self.z.eof:
                left = self.z.unused_data
                if not left and self.at >= len(self.data):
                    return 0
                self.z = zlib.decompressobj(31)
                self.rest = self.z.decompress(left) if left else b""
                if self.rest:
                    break
            if self.at >= len(self.data):
                return 0
            self.rest = self.z.decompress(self.data[self.at : self.at + (1 << 18)])
            self.at += 1 << 18
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def open_archive(data: bytes):
    return io.BufferedReader(_Unzipped(data), 1 << 18) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _failed(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, path string, number long, error string"


def _read_batches(batches):
    import pyarrow as pa

    schema = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith(" long") else pa.string()) for c in READ.split(", ")])
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, number = [], 0
            try:
                for number, record in enumerate(parse_warc(open_archive(data.as_py()))):
                    kind = record.get("WARC-Type")
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(record.block) or (b"", record.block)
                    digest = (record.get("WARC-Payload-Digest") or "").partition(":")[2]
                    size, error = int(http_header(head, b"Content-Length") or 0), None
                    if kind == "response":
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            error = "payload differs from its digest"
                    rows.append({"page_id": page_of(record.get("WARC-Record-ID")), "url": record.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(record.get("WARC-Refers-To")) if kind == "revisit" else None, "record_id": record.get("WARC-Record-ID"), "path": path, "number": number, "error": error})
            except (ValueError, EOFError, zlib.error, UnicodeDecodeError) as e:
                rows.append(dict.fromkeys(schema.names) | {"path": path, "number": number, "error": _failed(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _files(spark: SparkSession, path: str, pattern: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the files to read, and (path, length) of those that are too large, whose content is never loaded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.filter(F.col("length") <= max_bytes).select("path", "content"), files.filter(F.col("length") > max_bytes).select("path", "length")


def scan_archives(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The responses and revisits of the WARC files under ``path``, with ``error`` null.

    A response whose payload differs from its digest, a file that breaks off (at
    ``number``), and one that is too large are rows with an error.
    """
    good, large = _files(spark, path, pattern, max_bytes)
    rows = small_batches(good).mapInArrow(_read_batches, READ)
    return rows.unionByName(large.select("path", F.concat(F.lit("too large: "), "length").alias("error")), allowMissingColumns=True)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.txt*") -> tuple[DataFrame, DataFrame]:
    """Records and rejects (path, number, error) of `scan_archives`."""
    rows = scan_archives(spark, path, pattern)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("path", "number", "error")


ARC = "path string, offset long, url string, ip string, date string, mime string, content binary, error string"


class _Counted:
    """A stream that knows how many bytes were read."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def readline(self):
        out = self.stream.readline()
        self.at += len(out)
        return out

    def read(self, n):
        out = self.stream.read(n) if n >= 0 else b""
        self.at += len(out)
        return out


def _arc_batches(batches):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*((c.split(" ")[0], kinds[c.split(" ")[1]]) for c in ARC.split(", ")))
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, size = [], 0
            stream = _Counted(open_archive(data.as_py()))
            offset = 0
            try:
                for record in parse_arc(stream):
                    f = record.fields
                    rows.append((path, offset, f["URL"], f.get("IP-address"), f.get("Archive-date"), f.get("Content-type"), record.content, None))
                    offset, size = stream.at, size + len(record.content)
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))
                        rows, size = [], 0
            except (ValueError, EOFError, KeyError, zlib.error) as e:
                rows.append((path, offset, None, None, None, None, None, _failed(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=list(names))


def read_arc(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Records (path, offset, url, ip, date, mime, content) and rejects (path, offset, error) of ARC files, plain or gzip, of either version.

    A file is read up to its first malformed record, which is a reject; one above ``max_bytes`` is a reject unread.
    """
    good, large = _files(spark, path, pattern, max_bytes)
    rows = small_batches(good).mapInArrow(_arc_batches, ARC)
    rows = rows.unionByName(large.select("path", F.concat(F.lit("too large: "), "length").alias("error")), allowMissingColumns=True)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("path", "offset", "error")


def _convert_arc(limit: int):
    """Records of `read_arc` to WARC files. A record's id holds its file and offset."""

    def run(batches):
        files, path = None, None
        for batch in batches:
            for row in batch.to_pylist():
                arc = ArcRecord({"URL": row["url"], "IP-address": row["ip"] or "", "Archive-date": row["date"] or "", "Content-type": row["mime"] or ""}, row["content"])
                if files is None:
                    path = f"{row['path']} {row['offset']}"
                    files = _Files(limit, lambda k: convert(ArcRecord({"URL": "filedesc://records.arc"}, b""), place=f"{path} {k}"))
                if not row["url"].startswith("filedesc:"):
                    for done in files.add(member(convert(arc, place=f"{row['path']} {row['offset']}"))):
                        yield _file_batch([done])
        for done in files.flush() if files else ():
            yield _file_batch([done])

    return run


def convert_archives(spark: SparkSession, arc_path: str, path: str, archive_bytes: int = ARCHIVE_BYTES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write the records of the ARC files under ``arc_path`` as WARC files under ``path``; the rejects come back."""
    records, rejects = read_arc(spark, arc_path, max_bytes=max_bytes)
    _save(records.mapInArrow(_convert_arc(archive_bytes), "file binary"), path)
    return rejects


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC and read the archives back: one row per page. A record of these archives that can't be read fails the query."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    rows = scan_archives(pages.sparkSession, path, "*.txt*")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "error"))).otherwise(F.col("record_type"))
    return rows.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")
