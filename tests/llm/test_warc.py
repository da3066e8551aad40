import gzip
import hashlib
import io
import random
import zlib

import pytest

from quillmill.llm import warc as w

PAGES = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= 100 and h in first and i != first[h]
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


def run(spark, rows, path=None):
    return sorted((tuple(r) for r in w.archive_pages(spark.createDataFrame(rows, PAGES), path).collect()), key=repr)


def test_like_brute_force(spark):
    same = "<p>é" + "x" * 120
    rows = [(5, "http://a/ b\n", same), (3, "http://c", same), (9, None, same), (None, "http://d", same), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "", None), (6, "v", ""), (-7, "n", "line\r\n\r\nWARC/1.0\r\n" * 20), (-8, "n", "line\r\n\r\nWARC/1.0\r\n" * 20), (2**62 + 5, "big", "y\n" * 200), (3, "http://c", same), (None, "q", "z" * 200), (None, "q", "z" * 200), (-(2**63), "m", "low"), (11, "t", "\n\n\n")]
    assert run(spark, rows) == brute(rows)


def test_tables_like_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])
    assert sorted((tuple(r) for r in w.archive_pages(pages).collect()), key=repr) == want


def test_empty(spark):
    assert run(spark, []) == []


def test_files_are_warc(spark, tmp_path):
    path = f"{tmp_path}/archive"
    run(spark, [(1, "http://a.org/x", "<p>" + "é" * 200), (2, "http://b.org", "<p>" + "é" * 200)], f"file://{path}")
    records = [r for f in sorted((tmp_path / "archive").glob("*.txt")) for r in w.parse_warc(io.BytesIO(gzip.decompress(f.read_bytes())))]
    kinds = [r.get("WARC-Type") for r in records]
    assert kinds.count("response") == 1 and kinds.count("revisit") == 1 and "warcinfo" in kinds
    response = next(r for r in records if r.get("WARC-Type") == "response")
    revisit = next(r for r in records if r.get("WARC-Type") == "revisit")
    assert revisit.get("WARC-Refers-To") == response.get("WARC-Record-ID") and response.get("WARC-Date") == "2024-01-01T00:00:00Z"
    assert w.split_http(response.block)[1].decode() == "<p>" + "é" * 200


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_and_conversion(version):
    http = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>hello"
    data = w.arc_header(version, date="19970101") + w.arc_record(version, "http://x.org/", "text/html", http, date="199612312359") + w.arc_record(version, "dns:x.org", "text/dns", b"x.org. 1 IN A 1.2.3.4\n")
    arc = list(w.parse_arc(io.BytesIO(data)))
    assert [len(r.fields) for r in arc] == [5 if version == 1 else 10] * 3 and arc[1].content == http
    info, page, dns = map(w.convert, arc)
    assert [r.get("WARC-Type") for r in (info, page, dns)] == ["warcinfo", "response", "resource"]
    assert page.get("WARC-Date") == "1996-12-31T23:59:00Z" and info.get("WARC-Date") == "1997-01-01T00:00:00Z"
    assert page.get("WARC-Payload-Digest") == "sha256:" + hashlib.sha256(b"<p>hello").hexdigest()
    assert dns.get("Content-Type") == "text/dns"
    back = list(w.parse_warc(io.BytesIO(b"".join(r.to_bytes() for r in (info, page, dns)))))
    assert [b.block for b in back] == [r.block for r in (info, page, dns)]


def test_broken_archives():
    good = w.arc_header(1) + w.arc_record(1, "http://x", "text/html", b"abc")
    for bad in (good[:-3], good + b"http://y 1.1.1.1 text/html 4\nabcd\n", good + b"http://y 1.1.1.1 2000 text/html four\nabcd\n"):
        with pytest.raises(ValueError):
            list(w.parse_arc(io.BytesIO(bad)))


def test_ids_name_pages():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), 123456789, None):
        assert w.page_of(w.record_id("ab" * 32, page)) == page


def members(data):
    """Each gzip member of a file, unzipped."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        assert z.eof
        data = z.unused_data
    return out


def test_a_member_per_record_and_files_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"http://a/{k}", "".join(rng.choice("abcdefgh ") for _ in range(4000))) for k in range(60)] + [(99, "http://large", "".join(map(chr, rng.choices(range(0x20, 0x2000), k=40000))))]
    path = f"file://{tmp_path}/archive"
    w.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, archive_bytes=20_000)
    files = [f.read_bytes() for f in sorted((tmp_path / "archive").glob("*.txt"))]
    parts = [members(f) for f in files]
    assert all(len(f) <= 20_000 or len(p) == 2 for f, p in zip(files, parts)) and len(files) > 3
    ids = []
    for p in parts:
        for m in p:
            (record,) = w.parse_warc(io.BytesIO(m))
            ids.append(record.get("WARC-Record-ID"))
        assert next(w.parse_warc(io.BytesIO(p[0]))).get("WARC-Type") == "warcinfo"
    assert len(ids) == len(set(ids)) == 61 + len(files)
    good, bad = w.read_archives(spark, path)
    assert good.count() == 61 and bad.count() == 0


def test_a_member_always_ends_in_zero():
    for n in (10, 1 << 20, (16 << 20) + 5):
        data = w.member(w.WarcRecord([("WARC-Type", "resource")], b"a" * n))
        assert data.endswith(b"\0") and len(b"".join(members(data))) > n
        (record,) = w.parse_warc(w.open_archive(data))
        assert len(record.block) == n


def test_arc_files_are_a_source_with_rejects(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>hello"
    folder = tmp_path / "arcs"
    folder.mkdir()
    one = w.arc_header(1) + w.arc_record(1, "http://a.org/", "text/html", http) + w.arc_record(1, "dns:a.org", "text/dns", b"1.2.3.4")
    two = w.arc_header(2) + w.arc_record(2, "http://b.org/", "text/html", http)
    (folder / "one.arc").write_bytes(one)
    (folder / "two.arc.gz").write_bytes(gzip.compress(two))
    (folder / "cut.arc").write_bytes(one[:-9])
    (folder / "odd.arc").write_bytes(one + b"no header line\n")
    (folder / "neg.arc").write_bytes(w.arc_header(1) + b"http://a 0.0.0.0 2024 text/html -5\n")
    (folder / "large.arc").write_bytes(w.arc_header(1) + w.arc_record(1, "http://l/", "text/html", b"x" * 5000))
    (folder / "empty.arc").write_bytes(b"")
    rejects = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in w.convert_archives(spark, f"file://{folder}", f"file://{tmp_path}/warcs", max_bytes=4000).collect()}
    assert set(rejects) == {"cut.arc", "odd.arc", "neg.arc", "large.arc"} and "too large" in rejects["large.arc"]
    records = [r for f in (tmp_path / "warcs").glob("*.txt") for r in w.parse_warc(w.open_archive(f.read_bytes()))]
    kinds = sorted((r.get("WARC-Type"), r.get("WARC-Target-URI")) for r in records if r.get("WARC-Type") != "warcinfo")
    assert kinds == [("resource", "dns:a.org")] * 2 + [("response", "http://a.org/")] * 3 + [("response", "http://b.org/")]
    ids = [r.get("WARC-Record-ID") for r in records]
    assert len(ids) == len(set(ids))


def test_broken_archives_are_rejects(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    w.write_archives(spark.createDataFrame([(k, "http://a/", f"page {k} " * 30) for k in range(5)], PAGES).coalesce(1), path)
    (f,) = (tmp_path / "archive").glob("*.txt")
    data = b"".join(members(f.read_bytes()))
    (tmp_path / "archive" / "cut.txt").write_bytes(data[:-20])
    (tmp_path / "archive" / "changed.txt").write_bytes(data.replace(b"page 2 ", b"page 9 "))
    (tmp_path / "archive" / "other.txt").write_bytes(b"not an archive")
    for crc in (tmp_path / "archive").glob(".*.crc"):
        crc.unlink()
    good, bad = w.read_archives(spark, path)
    assert good.count() == 5 + 4 + 4
    assert {r["path"].rsplit("/", 1)[-1]: r["number"] for r in bad.collect()} == {"cut.txt": 4, "changed.txt": 3, "other.txt": 0}
