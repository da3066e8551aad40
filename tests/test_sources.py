import io
import zipfile

from pyspark.sql import functions as F

from quillmill.plans import fixtures as fx
from quillmill.sources import jsonio, parts

FILES = "path string, content binary"


def zipped(items):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in items:
            z.writestr(name, text)
    return out.getvalue()


def test_elements_of_a_package(spark):
    text = "First paragraph\ncell a | cell b\n  \nLast <&> one"
    df = spark.createDataFrame([("/a.docx", bytearray(fx._package(7, text, "en", "src3")))], FILES)
    got = [(r["type"], r["element_id"], r["footnote_id"], r["text"], r["empty"]) for r in parts.scan_elements(df).orderBy("seq").collect()]
    assert got == [
        ("paragraph", "paragraph_1", None, "First paragraph", False),
        ("paragraph", "paragraph_2", None, "", True),
        ("paragraph", "paragraph_3", None, "Last <&> one", False),
        ("paragraph", "paragraph_4", None, "", True),
        ("table_cell", "table_1_cell_1_1", None, "cell a", False),
        ("table_cell", "table_1_cell_1_2", None, "cell b", False),
        ("header", "header_1", None, "src3", False),
        ("textbox", "textbox_1", None, "en", False),
        ("footnote", "footnote_1", "7", "note of en", False),
    ]


def test_refused_packages(spark):
    entity = '<!DOCTYPE x [<!ENTITY a "b">]><w:document/>'
    files = [("/cut", fx._package(1, "a", "en", "s")[:200]), ("/no", b"no zip"), ("/up", zipped([("../x", "a")])), ("/dtd", zipped([("word/document.xml", entity)])), ("/none", zipped([("other", "a")]))]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], FILES)
    errors = {r["path"]: r["error"] for r in parts.scan_elements(df).collect()}
    assert set(errors) == {p for p, _ in files} and all(errors.values())
    assert "unsafe" in errors["/up"] and "refused" in errors["/dtd"]
    assert parts.unpack("/big", zipped([("a", "x" * 1000)]), limit=10)[0][3] == "too large when unpacked"


def test_nodes_and_round_trip(spark):
    data = fx._package(49, "a", "en", "s")
    df = spark.createDataFrame([("/a.docx", bytearray(data))], FILES)
    scanned = parts.scan_parts(df)
    nodes = parts.scan_nodes(scanned).collect()
    kinds = {(n["kind"], n["id"] or n["name"] or n["value"]) for n in nodes}
    assert {("relationship", "rId1"), ("style", "Standard"), ("setting", "trackRevisions"), ("comment", "0"), ("comment_reference", "1")} <= kinds
    assert [n["part_name"] for n in nodes if n["kind"] == "malformed"] == ["word/broken.xml"]
    assert bytes(parts.write_packages(scanned).first()["content"]) == data


def test_files_and_folders(spark, tmp_path):
    df = spark.createDataFrame([(f"/in/{n}", bytearray(fx._package(1, "a", "en", "s"))) for n in ("a.docx", "b.DOCX", "c.txt")], FILES)
    parts.save_packages(df, str(tmp_path / "out"))
    found = parts.scan_packages(spark, str(tmp_path / "out"))
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in found.collect()) == ["a.docx", "b.DOCX"]


def test_json_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n  "doc_id": 1, "type": "docx",\n  "elements": [{"type": "paragraph", "element_id": "paragraph_1", "text": "å", "empty": false}]\n}')
    got = jsonio.elements_of(jsonio.read_structure(spark, str(tmp_path / "s.json"))).collect()
    assert [(r["pos"], r["element_id"], r["text"]) for r in got] == [(1, "paragraph_1", "å")]
    (tmp_path / "c.json").write_text('{"doc_id": 1, "element_id": "p", "old": "a"}\n{"doc_id": "x"}\nnot json\n')
    good, bad = jsonio.read_changes(spark, str(tmp_path / "c.json"))
    assert good.count() == 1 and bad.count() == 2


def test_fixture_packages_cover_documents(spark):
    d = "/root/testdata/sf0.001"
    assert fx.packages(spark, d).count() == fx.docs(spark, d).count()
    assert fx.elements(spark, d).groupBy("doc_id", "element_id").count().filter(F.col("count") > 1).count() == 0


def document_of(data):
    from xml.etree import ElementTree

    found = {p[1]: p[2] for p in parts.unpack("x", data)}
    return found, ElementTree.fromstring(found["word/document.xml"])


def edits(spark, rows):
    return spark.createDataFrame(rows, "path string, change_no bigint, element_id string, segments array<struct<kind:string,val:string>>, motivation string")


def test_edits_in_a_package(spark):
    from quillmill.operators import package_xml as px

    W = parts.W
    data = fx._package(7, "Keep the old words\ncell a | cell b\nother", "en", "s")
    files = spark.createDataFrame([("/a.docx", bytearray(data)), ("/bad.docx", bytearray(b"zz"))], FILES)
    changes = edits(spark, [
        ("/a.docx", 1, "paragraph_1", [("text", "Keep "), ("strike", "old "), ("insert", "new"), ("text", "words ")], "shorter"),
        ("/a.docx", 2, "table_1_cell_1_2", [("strike", "cell b "), ("insert", "cell c ")], None),
        ("/a.docx", 3, "footnote_1", [("strike", "note of en"), ("insert", "a note")], "no comment here"),
        ("/a.docx", 4, "textbox_1", [("insert", "box")], None),
        ("/a.docx", 5, "paragraph_99", [("insert", "x")], None),
    ])
    for mode in ("simple", "tracked"):
        got = {r["path"]: r for r in px.edit_packages(files, changes, mode).collect()}
        assert got["/bad.docx"]["error"] and bytes(got["/bad.docx"]["content"]) == b"zz"
        assert got["/a.docx"]["applied"] == [1, 2, 3, 4] and got["/a.docx"]["failed"] == [5]
        found, root = document_of(bytes(got["/a.docx"]["content"]))
        assert b"shorter" in found["word/comments.xml"] and b"no comment here" not in found["word/comments.xml"]
        assert b"a note" in found["word/footnotes.xml"] and b"mainDocument" not in found["word/document.xml"]
        if mode == "tracked":
            marks = [(x.tag.removeprefix(W), x.get(f"{W}id"), "".join(t.text for t in x.iter() if t.tag in (f"{W}t", f"{W}delText"))) for x in root.iter() if x.tag in (f"{W}ins", f"{W}del")]
            assert marks[:2] == [("del", "1", "old "), ("ins", "2", "new ")]
        else:
            colors = [c.get(f"{W}val") for c in root.iter(f"{W}color")]
            assert colors[:2] == ["FF0000", "008000"] and root.find(f".//{W}ins") is None
        assert not any(parts.xml_error(c) for n, c in found.items() if n.endswith((".xml", ".rels")))


def test_repair_is_idempotent_and_complete():
    from quillmill.operators import package, package_xml as px

    found, _ = document_of(fx._package(4, "text", "en", "s"))
    found["word/comments.xml"] = b"<broken"
    once, done = px.repair(found)
    twice, again = px.repair(once)
    assert done and not again and once == twice
    nodes = [(n, *x) for n, c in once.items() if n.endswith((".xml", ".rels")) for x in parts.nodes_of(n, c)]
    assert set(package.REQUIRED_STYLES) <= {x[3] for x in nodes if x[1] == "style"}
    assert not [x for x in nodes if x[1] == "comment_reference"]
    assert {"/word/comments.xml", *(p for p, _ in package.COMMENT_OVERRIDES)} <= {x[4] for x in nodes if x[1] == "override"}
    del found["word/styles.xml"]
    assert "added style Normal" in px.repair(found)[1]


def test_prefixes_survive():
    from quillmill.operators import package_xml as px

    text = b'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:w14" mc:Ignorable="w14"><w:body/></w:document>'
    again = px.dump(*px.load(text))
    assert b'xmlns:w14="urn:w14"' in again and b'mc:Ignorable="w14"' in again and b"<w:body" in again
    assert parts.xml_error(again) is None


def test_elements_in_rows_equal_those_by_kind(spark):
    d = "/root/testdata/sf0.001"
    columns = ["doc_id", "pos", "seq", "type", "element_id", "footnote_id", "text", "empty"]
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert key(fx.elements(spark, d)) == key(fx.elements_by_kind(spark, d))


def test_sql_functions_and_data_source(spark, tmp_path):
    from quillmill.functions import register
    from quillmill.sources import datasource

    register.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM diff_words('a b', 'a c')").collect()] == [(0, "text", "a "), (1, "strike", "b "), (2, "insert", "c ")]
    assert spark.sql("SELECT similarity('abc', 'abd')").first()[0] == 67
    datasource.register(spark)
    (tmp_path / "x.docx").write_bytes(fx._package(1, "a", "en", "s"))
    (tmp_path / "y.txt").write_bytes(b"no")
    assert spark.read.format("office_parts").load(str(tmp_path)).count() == 8
