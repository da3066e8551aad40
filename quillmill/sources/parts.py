"""Office packages: zip files as (path, part, content), parts as rows, and back.

Packages are read with Spark's binary file reader and unpacked in the task;
nothing is written to local disk. A package is refused if a part's name leads
outside of it, if it is encrypted, or if it would expand beyond a limit; the
refusal is a row with ``error``. XML with a document type is refused, too.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PARTS

#: Bytes that a package may unpack to, unless a scan is told otherwise (``limit``): a package is one row of one task.
MAX_BYTES = 256 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RUN, TEXT = f"{W}r", f"{W}t"
ELEMENT_ROWS = "path string, seq bigint, type string, element_id string, footnote_id string, text string, empty boolean, error string"
#: Rows and characters that a frame of elements or packages holds at most, but for its last row: a worker's memory must not depend on a batch.
FRAME_ROWS, FRAME_CHARS = 10_000, 2 << 20
#: Bytes of a batch that carries packages, and the setting's name.
BATCH_BYTES, BATCH_SETTING = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parts up to this size are often the same in many packages, so their compressed form is kept.
SMALL_PART = 4096
#: File mode of an entry as zipfile writes it.
ENTRY_MODE = 0o600 << 16
NODE_ROWS = "path string, part_name string, kind string, ord int, id string, name string, value string, error string"


def _content(z: zipfile.ZipFile, data: bytes, info: zipfile.ZipInfo) -> bytes:
    """A part of the package; zipfile reads, or refuses, all but plain deflated ones."""
    at = info.header_offset
    if info.compress_type == zipfile.ZIP_DEFLATED and not info.flag_bits & 0x61 and at >= 0 and data[at : at + 4] == b"PK\x03\x04" and len(data) >= at + 30:
        name, extra = struct.unpack_from("<HH", data, at + 26)
        begin = at + 30 + name
        if info.orig_filename.isascii() and data[at + 30 : begin] == info.orig_filename.encode():
            try:
                out = zlib.decompressobj(-15).decompress(data[begin + extra : begin + extra + info.compress_size], info.file_size + 1)
            except zlib.error:
                out = b""
            if len(out) == info.file_size and zlib.crc32(out) == info.CRC:
                return out
    return z.read(info)


def unpack(path: str, data: bytes, limit: int = MAX_BYTES) -> list[tuple[str, str | None, bytes | None, str | None]]:
    """(path, part, content, error) of a package."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            out, total = [], 0
            for info in z.infolist():
                if info.is_dir():
                    continue
                if info.filename.startswith("/") or ".." in info.filename.split("/"):
                    return [(path, None, None, f"unsafe part name: {info.filename}")]
                if info.flag_bits & 1:
                    return [(path, None, None, "encrypted")]
                total += info.file_size
                if total > limit:
                    return [(path, None, None, "too large when unpacked")]
                out.append((path, info.filename, _content(z, data, info), None))
            return out
    except (zipfile.BadZipFile, EOFError, OSError, ValueError, NotImplementedError) as e:
        return [(path, None, None, f"not a package: {type(e).__name__}")]


def _deflated(content: bytes) -> tuple[bytes, int]:
    deflate = zlib.compressobj(-1, zlib.DEFLATED, -15)
    return deflate.compress(content) + deflate.flush(), zlib.crc32(content)


#: Small parts' compressed forms, CACHED of them at most. A plain table, as functions go to the workers by value.
_small: dict[bytes, tuple[bytes, int]] = {}
CACHED = 512


def _deflated_small(content: bytes) -> tuple[bytes, int]:
    found = _small.get(content)
    if found is None:
        found = _deflated(content)
        if len(_small) < CACHED:
            _small[content] = found
    return found


def pack(parts: list[tuple[str, bytes]]) -> bytes:
    """A package of the parts, in order of their names, content types first; equal parts give equal bytes.

    The bytes are zipfile's. It writes large packages and odd names itself.
    """
    ordered = sorted(parts, key=lambda p: (p[0] != "[Content_Types].xml", p[0]))
    if len(ordered) > 1000 or sum(len(c) for _, c in ordered) > 1 << 30 or not all(n.isascii() and "\0" not in n and n[-1:] != "/" for n, _ in ordered) or len({n for n, _ in ordered}) < len(ordered):
        return _pack_any(ordered)
    out, directory, at = [], [], 0
    for name, content in ordered:
        packed, crc = (_deflated_small if len(content) <= SMALL_PART else _deflated)(content)
        raw = name.encode()
        # both headers share: version 20, no flags, deflated, 1980-01-01, sizes, no extra field
        shared = struct.pack("<HHHHHLLLHH", 20, 0, 8, 0, 33, crc, len(packed), len(content), len(raw), 0)
        out += (b"PK\x03\x04", shared, raw, packed)
        directory += (b"PK\x01\x02", b"\x14\x03", shared, struct.pack("<HHHLL", 0, 0, 0, ENTRY_MODE, at), raw)
        at += 30 + len(raw) + len(packed)
    listing = b"".join(directory)
    return b"".join((*out, listing, b"PK\x05\x06", struct.pack("<HHHHLLH", 0, 0, len(ordered), len(ordered), len(listing), at, 0)))


def _pack_any(ordered: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in ordered:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def parse_xml(content: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in content[:4096] or b"<!ENTITY" in content:
        raise ValueError("document type refused")
    return ElementTree.fromstring(content)


def xml_error(content: bytes) -> str | None:
    try:
        parse_xml(content)
    except (ElementTree.ParseError, ValueError) as e:
        return str(e)
    return None


def _texts(node: ElementTree.Element) -> list[str]:
    return [t.text or "" for t in node.iter(f"{W}t")]


def paragraph_text(p: ElementTree.Element) -> str:
    """Text of a paragraph's own runs (also inside links), without text boxes."""
    if all(r.tag == RUN and len(r) == 1 and r[0].tag == TEXT for r in p):
        return "".join([r[0].text or "" for r in p])
    out = []

    def walk(node):
        for child in node:
            if child.tag in (f"{W}drawing", f"{W}pict"):
                continue
            if child.tag == f"{W}t":
                out.append(child.text or "")
            elif child.tag == f"{W}tab":
                out.append("\t")
            elif child.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
            else:
                walk(child)

    walk(p)
    return "".join(out)


def elements_of(parts: dict[str, bytes], parsed: Callable[[str], ElementTree.Element] | None = None) -> Iterator[tuple[str, str, str | None, str]]:
    """(type, element_id, footnote_id, text) of a package, in the order of kinds. ``parsed`` gives the roots of parts that are parsed already."""
    parsed = parsed or (lambda name: parse_xml(parts[name]))
    document = parsed("word/document.xml")
    body = document.find(f"{W}body")
    if body is None:
        return
    tops = body.findall(f"{W}p")
    for n, p in enumerate(tops, 1):
        yield "paragraph", f"paragraph_{n}", None, paragraph_text(p).strip()
    for t, table in enumerate(body.findall(f"{W}tbl"), 1):
        for r, row in enumerate(table.findall(f"{W}tr"), 1):
            c = 0
            for cell in row.findall(f"{W}tc"):
                text = "\n".join(paragraph_text(p) for p in cell.findall(f"{W}p")).strip()
                span = cell.find(f"{W}tcPr/{W}gridSpan")
                for _ in range(int(span.get(f"{W}val", "1")) if span is not None else 1):  # a merged cell counts for each column
                    c += 1
                    yield "table_cell", f"table_{t}_cell_{r}_{c}", None, text
    rels = {}
    if "word/_rels/document.xml.rels" in parts:
        rels = {r.get("Id"): r.get("Target") for r in parsed("word/_rels/document.xml.rels")}
    first = next(document.iter(f"{W}sectPr"), None)
    for kind in ("header", "footer"):
        refs = [] if first is None else [r for r in first.findall(f"{W}{kind}Reference") if r.get(f"{W}type", "default") == "default"]
        n = 0
        for ref in refs:
            name = "word/" + (rels.get(ref.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")) or "")
            for p in parsed(name).findall(f"{W}p") if name in parts else []:
                n += 1
                yield kind, f"{kind}_{n}", None, paragraph_text(p).strip()
    n = 0
    for p in tops:
        for drawing in p.iter(f"{W}drawing"):
            text = " ".join(_texts(drawing)).strip()
            if text:
                n += 1
                yield "textbox", f"textbox_{n}", None, text
    if "word/footnotes.xml" in parts:
        n = 0
        for note in parsed("word/footnotes.xml").findall(f"{W}footnote"):
            note_id, text = note.get(f"{W}id"), "".join(_texts(note)).strip()
            if note_id not in ("-1", "0") and text:
                n += 1
                yield "footnote", f"footnote_{n}", note_id, text


def nodes_of(name: str, content: bytes) -> Iterator[tuple[str, int, str | None, str | None, str | None]]:
    """(kind, ord, id, name, value) of what validation and repair look at in a part."""
    root = parse_xml(content)
    if name.endswith("document.xml.rels"):
        for k, r in enumerate(root):
            yield "relationship", k, r.get("Id"), r.get("Type"), r.get("Target")
    elif name == "[Content_Types].xml":
        for k, r in enumerate(x for x in root if x.tag.endswith("}Override")):
            yield "override", k, None, r.get("PartName"), r.get("ContentType")
    elif name == "word/styles.xml":
        for k, s in enumerate(root.iter(f"{W}style")):
            label = s.find(f"{W}name")
            yield "style", k, s.get(f"{W}styleId"), None if label is None else label.get(f"{W}val"), s.get(f"{W}type")
    elif name == "word/settings.xml":
        yield from (("setting", k, None, x.tag.split("}")[-1], x.get(f"{W}val")) for k, x in enumerate(root))
        yield from (("rsid", k, None, None, x.get(f"{W}val")) for k, x in enumerate(root.iter(f"{W}rsid")))
    elif name == "word/comments.xml":
        yield from (("comment", k, x.get(f"{W}id"), x.get(f"{W}author"), "".join(_texts(x))) for k, x in enumerate(root.iter(f"{W}comment")))
    elif name == "word/document.xml":
        yield from (("comment_reference", k, x.get(f"{W}id"), None, None) for k, x in enumerate(root.iter(f"{W}commentReference")))
        yield "paragraphs", 0, None, None, str(sum(1 for _ in root.iter(f"{W}p")))


def scan_packages(spark: SparkSession, folder: str, suffix: str = ".docx") -> DataFrame:
    """The files of a folder (not of its subfolders) with the suffix in any case: path, modificationTime, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.filter(F.lower("path").endswith(suffix))


def scan_parts(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """(path, part_name, content, error) of packages (path, content); one that unpacks to more than ``limit`` bytes has an error."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(unpack(path, bytes(data), limit), columns=["path", "part_name", "content", "error"])

    return files.select("path", "content").mapInPandas(run, PARTS)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands packages to Python in batches of BATCH_BYTES at most, unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, str(64 << 20)) in (str(64 << 20), f"{64 << 20}b"):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def scan_elements(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Elements of packages; a package that can't be read, or unpacks to more than ``limit`` bytes, gives one row with ``error``."""

    def run(batches):
        import pandas as pd

        frame = lambda rows: pd.DataFrame(rows, columns=["path", "seq", "type", "element_id", "footnote_id", "text", "empty", "error"]).astype({"seq": "Int64", "empty": "boolean"})
        for batch in batches:
            rows, chars = [], 0
            for path, data in zip(batch["path"], batch["content"]):
                parts = unpack(path, bytes(data), limit)
                try:
                    if parts and parts[0][3]:
                        raise ValueError(parts[0][3])
                    for k, (kind, eid, note, text) in enumerate(elements_of({p[1]: p[2] for p in parts}), 1):
                        rows.append((path, k, kind, eid, note, text, not text, None))
                        chars += len(text)
                except (ValueError, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if len(rows) >= FRAME_ROWS or chars >= FRAME_CHARS:
                    yield frame(rows)
                    rows, chars = [], 0
            yield frame(rows)

    return small_batches(files).select("path", "content").mapInPandas(run, ELEMENT_ROWS)


def scan_nodes(parts: DataFrame) -> DataFrame:
    """Node rows of the parts that rules look at; a malformed part gives a row of kind ``malformed``."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, name, content in zip(batch["path"], batch["part_name"], batch["content"]):
                try:
                    rows += [(path, name, *n, None) for n in nodes_of(name, bytes(content))]
                except (ValueError, ElementTree.ParseError) as e:
                    rows.append((path, name, "malformed", 0, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "part_name", "kind", "ord", "id", "name", "value", "error"])

    xml = F.col("part_name").endswith(".xml") | F.col("part_name").endswith(".rels")
    return parts.filter(xml).select("path", "part_name", "content").mapInPandas(run, NODE_ROWS)


def write_packages(parts: DataFrame) -> DataFrame:
    """(path, content): packages put together from their parts. One package is one group, as large as the limit that it was scanned with."""

    def run(key, group):
        import pandas as pd

        return pd.DataFrame({"path": [key[0]], "content": [pack([(n, bytes(c)) for n, c in zip(group["part_name"], group["content"])])]})

    return parts.filter("error IS NULL").select("path", "part_name", "content").groupBy("path").applyInPandas(run, "path string, content binary")


def save_packages(packages: DataFrame, folder: str) -> None:
    """Write packages (path, content) as files of their base name under ``folder``, through Arrow's file systems.

    A file is written whole under its final name, so a repeated task writes the same bytes again.
    """

    def put(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{base}/{row['path'].rsplit('/', 1)[-1]}") as out:
                out.write(bytes(row["content"]))

    packages.select("path", "content").foreachPartition(put)
