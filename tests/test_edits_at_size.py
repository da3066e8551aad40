"""What keeps the editing of many packages cheap, and equal to the plain way."""

import itertools
import random
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from quillmill.functions import udfs
from quillmill.operators import batching, package_xml as px
from quillmill.plans import fixtures as fx
from quillmill.plans import review
from quillmill.sources import parts

TEXT = "the one & two\nof <three> the four\ncell the | b\n"


def edited(mode="tracked"):
    editor = px.Editor({p[1]: p[2] for p in parts.unpack("x", fx._package(3, TEXT, "en", "the s"))}, mode, "q", "2024-01-01T00:00:00Z")
    for n in (1, 2):
        assert editor.apply(f"paragraph_{n}", [("text", "one "), ("strike", "a&b "), ("insert", "c<d"), ("text", "two "), ("text", "")], "why")
    return editor


def test_a_document_is_parsed_and_written_once(monkeypatch):
    loads, dumps = [], []
    load, dump = px.load, px.dump
    monkeypatch.setattr(px, "load", lambda content: loads.append(content) or load(content))
    monkeypatch.setattr(px, "dump", lambda root, prefixes: dumps.append(root.tag) or dump(root, prefixes))
    editor = edited()
    editor.texts()
    held = editor.result()
    px.repair_held(held)
    held.all()
    assert sum(b"<w:document" in x for x in loads) == 1 and dumps.count(f"{parts.W}document") == 1 and dumps.count(f"{parts.W}comments") == 1


def test_written_as_elementtree_writes():
    for mode in ("simple", "tracked"):
        for content in edited(mode).result().all().values():
            root, prefixes = px.load(content)
            for p, u in prefixes.items():
                ET.register_namespace(p, u)
            assert px._written(root, prefixes) == ET.tostring(root, encoding="unicode")
    odd = '<a:x xmlns:a="urn:a" xmlns="urn:d" t="&quot;&#10;&lt;"><y xml:space="preserve">&amp; </y> &gt;<b:z xmlns:b="urn:b" b:k="1"/></a:x>'.encode()
    root, prefixes = px.load(odd)
    assert prefixes == {"a": "urn:a", "": "urn:d", "b": "urn:b"} and ET.canonicalize(px.dump(root, prefixes).decode()) == ET.canonicalize(odd.decode())


def test_characters_that_xml_cannot_hold(spark):
    files = spark.createDataFrame([("/a.docx", bytearray(fx._package(1, "one", "en", "s")))], "path string, content binary")
    edits = spark.createDataFrame([("/a.docx", 1, "paragraph_1", [("insert", "a\x01")], None)], "path string, change_no bigint, element_id string, segments array<struct<kind:string,val:string>>, motivation string")
    got = px.edit_packages(files, edits, "tracked").first()
    assert "XML" in got["error"] and not got["applied"] and bytes(got["content"]) == fx._package(1, "one", "en", "s")


def test_one_changed_word_as_difflib_shows_it(monkeypatch):
    rng = random.Random(5)
    pairs = [(a, k, y) for n in range(1, 7) for a in itertools.product("xyz", repeat=n) for k in range(n) for y in "wx"]
    pairs += [(tuple(rng.choice("abc") for _ in range(n)), rng.randrange(n), "q") for n in (30, 198, 199, 200, 230) for _ in range(60)]
    words = [f"w{k}" for k in range(150)]
    many = [(tuple(rng.choice(("the", "of", *words[: rng.choice((5, 60, 150))])) for _ in range(n)), rng.randrange(n), rng.choice(("q", "of", "w1"))) for n in (200, 260, 420) for _ in range(60)]
    pairs += many + [(a, k, y) for a, _, y in many for k in (0, len(a) - 1)]
    assert sum(udfs.one_word(list(a), [*a[:k], y, *a[k + 1 :]]) is not None for a, k, y in many) > 20
    cases = [(" ".join(a), " ".join((*a[:k], y, *a[k + 1 :]))) for a, k, y in pairs]
    fast = [udfs.ndiff_words(a, b) for a, b in cases]
    assert sum(udfs.one_word(a.split(), b.split()) is not None for a, b in cases) > 1000
    monkeypatch.setattr(udfs, "one_word", lambda a, b: None)
    assert fast == [udfs.ndiff_words(a, b) for a, b in cases]


def test_packages_as_zipfile_makes_them():
    content = [("word/b.xml", b"b" * 9000), ("[Content_Types].xml", b"<t/>"), ("a.xml", b"")]
    data = parts.pack(content)
    assert data == parts._pack_any(sorted(content, key=lambda p: (p[0] != "[Content_Types].xml", p[0])))
    assert sorted((p[1], p[2]) for p in parts.unpack("x", data)) == sorted(content)
    at = data.index(b"PK\x01\x02") + 16  # a checksum
    assert parts.unpack("x", data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])[0][3].startswith("not a package")


def test_batches_without_a_join(spark):
    d = "/root/testdata/sf0.001"
    elements = fx.elements(spark, d).filter("doc_id < 40")
    size = batching.element_length()
    chunks = batching.chunk_greedy(elements, size, 6, 200)
    key = lambda df: sorted((r["doc_id"], r["chunk_id"], r["messages"][1]["content"]) for r in df.collect())
    want = key(batching.messages(elements, chunks, "policy", "Part:"))
    assert key(batching.greedy_messages(elements, size, "policy", "Part:", 200)) == want and len({c for _, c, _ in want}) > 1


def test_no_text_is_sent_beside_its_package(spark):
    files = spark.createDataFrame([("/a.docx", bytearray(fx._package(1, TEXT, "en", "the s")))], "path string, content binary")
    found = parts.scan_elements(files).selectExpr("1L AS doc_id", "seq AS pos", "type", "element_id", "footnote_id", "text", "empty")
    done = review.review(found, review.RuleSuggester(fx.LEXICON), "policy")
    edits = review.package_edits(done, F.lit("/a.docx"))
    assert {"segments", "text", "result"}.isdisjoint(edits.columns)
    # as with segments that are made before
    old = done.verdicts.join(done.comments.select("change_no", "motivation"), "change_no", "left").join(done.segments.groupBy("change_no").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "val"))).alias("s")), "change_no")
    given = old.select(F.lit("/a.docx").alias("path"), "change_no", "element_id", "par_no", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["val"].alias("val"))).alias("segments"), "motivation")
    a, b = (px.edit_packages(files, e, "tracked").first() for e in (edits, given))
    assert bytes(a["content"]) == bytes(b["content"]) and a["applied"] == b["applied"] and len(a["applied"]) == 5
