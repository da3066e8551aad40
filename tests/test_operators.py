import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.operators import batching, diff, jobs, match, package, pdf, suggest, tracked
from quillmill.plans import fixtures as fx
from quillmill.plans import review
from quillmill.schemas import ANNOTATIONS
from quillmill.sources import elements as el
from quillmill.sources import policy


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- batches


def loop(sizes, prompt, budget, parity=False):
    used, chunk, out, open_ = prompt, 0, [], parity
    for n in sizes:
        if open_ and used + n > budget:
            chunk, used = chunk + 1, prompt
        used, open_ = used + n, True
        out.append(chunk)
    return out


def test_batches_like_a_loop(spark):
    rng = random.Random(1)
    data = {i: [rng.choice([1, 50, 200, 390, 500]) for _ in range(rng.randint(0, 60))] for i in range(40)}
    df = spark.createDataFrame([(i, k, n) for i, ns in data.items() for k, n in enumerate(ns)], "doc_id long, pos long, n long")
    want = sorted((i, k, c) for i, ns in data.items() for k, c in enumerate(loop(ns, 10, 400)))
    assert rows(batching.chunk_greedy(df, F.col("n"), 10, 100), "doc_id", "pos", "chunk_id") == sorted(want, key=repr)
    assert rows(batching.chunk_greedy_grouped(df, F.col("n"), 10, 100), "doc_id", "pos", "chunk_id") == sorted(want, key=repr)
    parity = sorted(((i, k, c) for i, ns in data.items() for k, c in enumerate(loop(ns, 10, 400, True))), key=repr)
    assert rows(batching.chunk_greedy(df, F.col("n"), 10, 100, empty_first=True), "doc_id", "pos", "chunk_id") == parity


@settings(max_examples=100)
@given(st.lists(st.integers(1, 500), max_size=50))
def test_loop_keeps_budget(sizes):
    chunks = loop(sizes, 10, 400)
    assert chunks == sorted(chunks)
    for c in set(chunks):
        inside = [n for n, x in zip(sizes, chunks) if x == c]
        assert 10 + sum(inside) <= 400 or len(inside) == 1


# ---- replies


def test_replies_are_parsed_or_rejected(spark):
    raw = [
        (1, 0, True, '```json\n[{"element_id": "p", "old": "a", "new": "b", "page": 3}]\n```'),
        (1, 1, True, '{"element_id": "p"}'),
        (1, 2, True, "I am sorry"),
        (1, 3, False, None),
        (1, 4, True, "[]"),
        (1, 5, True, '[{"page": "seven"}, {"page": "8", "old": "x"}]'),
        (1, 6, True, '[{"old": "a"'),
        (2, 0, True, None),
    ]
    df = spark.createDataFrame(raw, "doc_id long, chunk_id long, ok boolean, raw string")
    items, bad = suggest.parse_replies(df)
    assert rows(items, "chunk_id", "pos", "element_id", "page", "old") == [(0, 0, "p", 3, "a"), (5, 1, None, 8, "x")]
    reasons = dict(((r["doc_id"], r["chunk_id"]), r["reason"]) for r in bad.collect())
    assert reasons[(1, 1)] == reasons[(1, 2)] == reasons[(2, 0)] == "not an array" and reasons[(1, 3)] == "failed" and reasons[(1, 6)] == "not JSON"
    outcomes = {(r["doc_id"], r["chunk_id"]): (r["outcome"], r["n_items"]) for r in suggest.batch_outcomes(df).collect()}
    assert outcomes[(1, 0)] == ("ok", 1) and outcomes[(1, 4)] == ("ok", 0) and outcomes[(1, 3)] == ("failed", 0)


def test_suggesters(spark):
    batches = spark.createDataFrame([(1, 0, [("system", "p"), ("user", "hello")]), (1, 1, [("system", "p"), ("user", "boom")])], "doc_id long, chunk_id long, messages array<struct<role:string,content:string>>")

    def ask(messages):
        if messages[1]["content"] == "boom":
            raise RuntimeError("no answer")
        return "[]"

    got = {r["chunk_id"]: (r["ok"], r["raw"]) for r in suggest.FunctionSuggester(ask, 2).replies(batches).collect()}
    assert got == {0: (True, "[]"), 1: (False, "RuntimeError: no answer")}
    table = suggest.TableSuggester(spark.createDataFrame([(1, 1, "[]")], "doc_id long, chunk_id long, raw string"))
    assert rows(table.replies(batches), "chunk_id", "ok") == [(0, False), (1, True)]


# ---- matching

ELEMENTS = "doc_id long, element_id string, type string, text string, seq long"
CHANGES = "doc_id long, change_no long, element_id string, footnote_id string, old string, new string, motivation string"


def test_verdicts(spark):
    elements = spark.createDataFrame(
        [(1, "paragraph_1", "paragraph", "The  quick brown fox", 1), (1, "paragraph_2", "paragraph", "abcdefghijklmnopqrstuvwxyz", 2), (1, "table_1_cell_1_1", "table_cell", "123", 1), (1, "footnote_1", "footnote", "note", 1), (1, "other_1", "x", "the", 1)], ELEMENTS
    )
    changes = [(1, 1, "paragraph_1", "quick brown"), (1, 2, "paragraph_2", "abcdefghijklmnopqrstuvwxyZ"), (1, 3, "paragraph_2", "nothing alike"), (1, 4, "table_1_cell_1_1", "99"), (1, 5, "footnote_1", "x"), (1, 6, "other_1", "the"), (1, 7, "paragraph_9", "the"), (1, 8, None, "the"), (1, 9, "paragraph_1", None), (1, 10, "paragraph_1", ""), (2, 11, "paragraph_1", "quick")]
    df = spark.createDataFrame([(i, n, e, None, o, "new", None) for i, n, e, o in changes], CHANGES)
    got = {r["change_no"]: (r["verdict"], r["score"]) for r in match.verdicts(df, elements).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "exact", 2: "fuzzy", 3: "no_match", 4: "too_short", 5: "deferred", 6: "unsupported", 7: "unknown_element", 8: "unknown_element", 9: "missing_old", 10: "exact", 11: "unknown_element"}
    assert got[2][1] == 96
    summary = {r["doc_id"]: r for r in match.summary(match.verdicts(df, elements)).collect()}
    assert summary[1]["n_changes"] == 10 and summary[1]["n_exact"] == 2 and summary[1]["n_unapplied"] == 6


def test_cells_boxes_and_sequences(spark):
    cells = spark.createDataFrame([(1, "c", 0, "first words"), (1, "c", 1, "second words"), (1, "d", 0, "abcdefghij"), (1, "d", 1, "klmnopqrst")], "doc_id long, element_id string, par_no long, text string")
    changes = spark.createDataFrame([(1, 1, "c", "words", "x"), (1, 2, "c", "second", "x"), (1, 3, "d", "abcdefghij klmnopqrsX", "x"), (1, 4, "d", "zz", "x"), (1, 5, "d", "12345", "x")], "doc_id long, change_no long, element_id string, old string, new string")
    assert rows(match.cell_matches(changes, cells), "change_no", "par_no", "how") == [(1, 0, "exact"), (2, 1, "exact"), (3, 0, "fuzzy")]
    boxes = spark.createDataFrame([(1, "textbox_1", 1, "A – b"), (1, "textbox_2", 2, "x a-b y")], "doc_id long, element_id string, seq long, text string")
    wanted = spark.createDataFrame([(1, 1, "textbox_2", "a - b", "n"), (1, 2, "textbox_1", "A-b", "n"), (1, 3, "textbox_1", "none", "n")], "doc_id long, change_no long, element_id string, old string, new string")
    assert rows(match.join_textboxes(wanted, boxes), "change_no", "box_id", "other_box") == [(1, "textbox_2", False), (2, "textbox_1", False)]
    matched = spark.createDataFrame([(1, "p", 2, "a b c", "B", "C"), (1, "p", 1, "a b c", "b", "B"), (2, "p", 1, "q", "q", None)], "doc_id long, element_id string, change_no long, text string, old string, new string")
    assert rows(match.apply_sequential(matched), "doc_id", "result", "conflict") == [(1, "a C c", True), (2, "", False)]


# ---- pdf


def greedy(notes):
    kept = []
    for o, x0, y0, x1, y1, t in notes:
        if not any(t == k[5] or all(abs(a - b) < 5 for a, b in zip((x0, y0, x1, y1), k[1:5])) for k in kept):
            kept.append((o, x0, y0, x1, y1, t))
    return [k[0] for k in kept]


def test_dedupe_like_a_loop_and_idempotent(spark):
    rng = random.Random(2)
    notes = [(k, *(rng.choice([0.0, 4.9, 5.0, 9.9]) for _ in range(4)), rng.choice("abcdefgh")) for k in range(40)]
    df = spark.createDataFrame([(1, 1, *n) for n in notes] + [(2, 1, *n) for n in notes[::-1]], ANNOTATIONS)
    once = pdf.dedupe_notes(df)
    assert sorted(r["ord"] for r in once.filter("doc_id = 1").collect()) == greedy(notes)
    assert rows(pdf.dedupe_notes(once), "doc_id", "ord") == rows(once, "doc_id", "ord")


def test_lines_near_and_on_page(spark):
    lines = spark.createDataFrame([(1, 1, 1, "alpha beta15"), (1, 1, 3, "gamma"), (1, 1, 5, "delta alpha beta"), (1, 1, 8, "Alpha beta")], "doc_id long, page int, line int, text string")
    changes = [(1, 1, 1, 1, "alpha beta"), (1, 2, 1, 3, "alpha beta"), (1, 3, 1, None, "alpha BETA"), (1, 4, 1, 8, "gamma"), (1, 5, 1, 0, "delta"), (1, 6, 9, 1, "x"), (1, 7, 0, 1, "x"), (1, 8, 1, 1, None), (1, 9, None, 1, "x")]
    df = spark.createDataFrame([(i, n, p, li, o, "new", None) for i, n, p, li, o in changes], "doc_id long, change_no long, page int, line int, old string, new string, motivation string")
    good = pdf.valid(df, spark.createDataFrame([(1, 1)], "doc_id long, n_pages int"))
    assert rows(pdf.matches(good, lines), "change_no", "line", "how") == [(1, 1, "exact"), (2, 1, "near"), (3, 1, "page"), (3, 5, "page"), (3, 8, "page"), (5, 5, "page")]


def test_line_order_is_a_parameter(spark):
    blocks = spark.createDataFrame([(1, 1, 1, 0.0, 10.0, 1.0, 1.0, "top"), (1, 1, 2, 0.0, 20.0, 1.0, 1.0, " "), (1, 1, 3, 0.0, 20.0, 1.0, 1.0, "low")], "doc_id long, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    assert rows(el.pdf_lines(blocks), "line", "text") == [(2, "low"), (3, "top")]
    assert rows(el.pdf_lines(blocks, descending=False), "line", "text") == [(1, "top"), (3, "low")]


# ---- tracked changes, packages, jobs, policy


def test_tracked(spark):
    runs = spark.createDataFrame([(1, "word/document.xml", 1, 0, "FF0000", True, "gone", "5"), (1, "word/document.xml", 1, 1, "008000", None, "new.", None), (1, "word/document.xml", 1, 2, "FF0000", False, "red", None), (1, "word/footnotes.xml", 1, 0, "008000", None, "n", None)], "doc_id long, part_name string, para_no int, run_no int, color string, strike boolean, text string, comment_ref string")
    assert rows(tracked.tracked_segments(runs), "change_id", "kind", "text", "comment_ref") == [(1, "del", "gone ", "5"), (2, "ins", "new.", None)]
    assert rows(tracked.tracked_segments(runs, False), "comment_ref") == [(None,), (None,)]


def test_slots_behind_all_text_are_null(spark):
    segments = spark.createDataFrame([(1, 1, 0, "text", "abc "), (1, 1, 1, "insert", "zzzzzzzz "), (1, 1, 2, "strike", "de ")], "doc_id long, change_no long, ord int, kind string, val string")
    refs = spark.createDataFrame([(1, 1, "a", 4), (1, 1, "b", 5), (1, 1, "c", 99)], "doc_id long, change_no long, ref_id string, off long")
    assert rows(diff.footnote_slots(segments, refs), "ref_id", "slot") == [("a", 0), ("b", 2), ("c", None)]


def test_package_rules(spark):
    refs = spark.createDataFrame([(1, "1"), (1, "2"), (1, "2")], "doc_id long, comment_id string")
    comments = spark.createDataFrame([(1, "1", "t"), (1, "x", "t")], "doc_id long, comment_id string, text string")
    assert rows(package.with_missing_comments(comments, refs), "comment_id", "made") == [("1", False), ("2", True), ("x", False)]
    assert rows(package.next_comment_id(comments), "next_id") == [(2,)]
    rels = spark.createDataFrame([(1, "rId1"), (1, "rId2"), (1, "rId2"), (1, "rId4"), (2, "rId9")], "doc_id long, rid string")
    assert rows(package.first_free_rid(rels), "doc_id", "free_rid") == [(1, "rId3"), (2, "rId1")]
    assert len(package.STYLE_NAMES) == 59 and package.STYLE_NAMES["IAF"] == "TableNormal"


def test_poll_answers(spark):
    events = spark.createDataFrame([(1, 1, "a", False, None), (1, 2, "b", True, None), (2, 1, "a", False, None), (3, 1, "x", True, "bad"), (4, 1, "d", True, None)], "job_id long, seq long, status string, done boolean, error string")
    results = spark.createDataFrame([(1,), (9,)], "job_id long")
    assert rows(jobs.status(jobs.latest_status(events), results), "job_id", "code") == [(1, 200), (2, 202), (3, 500), (4, 500), (9, 200)]


def test_policy_without_markers(spark):
    df = spark.createDataFrame([("no markers",), (f"b {policy.START_EDITABLE} e {policy.END_EDITABLE} a",), (f"{policy.END_EDITABLE} wrong order {policy.START_EDITABLE}",), (None,)], "text string")
    got = [tuple(r) for r in policy.sections(df).select("valid", "editable", "locked_before", "locked_after").collect()]
    assert got[0] == (False, None, None, None) and got[1] == (True, "e", "b", "a") and got[2][:2] == (True, "") and got[3][0] is False


def test_review_end_to_end(spark):
    elements = spark.createDataFrame([(1, 1, "paragraph", "paragraph_1", None, "This is the end, the \"end\".", False), (1, 2, "paragraph", "paragraph_2", None, "", True), (2, 1, "paragraph", "paragraph_1", None, "Nothing here", False)], "doc_id long, pos long, type string, element_id string, footnote_id string, text string, empty boolean")
    out = review.review(elements, review.RuleSuggester({"the": "an"}), "policy")
    assert rows(out.verdicts, "doc_id", "element_id", "verdict") == [(1, "paragraph_1", "exact")]
    assert out.rejects.count() == 0 and out.comments.count() == 1
    words = [r["val"].strip() for r in out.segments.orderBy("ord").collect() if r["kind"] != "strike"]
    assert " ".join(words) == 'This is an end, the "end".'


class FixedSuggester:
    """The same changes for every batch."""

    def __init__(self, changes):
        self.raw = json.dumps(changes)

    def replies(self, batches):
        return batches.select("doc_id", "chunk_id", F.lit(True).alias("ok"), F.lit(self.raw).alias("raw"))


def test_all_changes_of_a_paragraph_reach_the_package(spark):
    from quillmill.operators import package_xml as px
    from quillmill.sources import parts

    elements = spark.createDataFrame([(1, 1, "paragraph", "paragraph_1", None, "one two three", False)], "doc_id long, pos long, type string, element_id string, footnote_id string, text string, empty boolean")
    changes = [{"element_id": "paragraph_1", "old": o, "new": n, "motivation": why} for o, n, why in (("one", "1", "a"), ("three", "3", "b"), ("one two", "x", "c"))]
    edits = review.package_edits(review.review(elements, FixedSuggester(changes), "policy"), F.lit("/a.docx"))
    files = spark.createDataFrame([("/a.docx", bytearray(fx._package(1, "one two three", "en", "s")))], "path string, content binary")
    got = px.edit_packages(files, edits, "simple").first()
    assert got["applied"] == [1, 2] and got["failed"] == [3]
    document = {p[1]: p[2] for p in parts.unpack("x", bytes(got["content"]))}["word/document.xml"].decode()
    assert ">1 <" in document and ">3" in document


def test_cells_of_several_paragraphs(spark):
    from quillmill.operators import package_xml as px
    from quillmill.sources import parts

    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f"<w:tbl><w:tr><w:tc><w:p/>{run('first words')}{run('second part')}</w:tc><w:tc>{run('one')}{run('two')}</w:tc></w:tr></w:tbl>"
    package = {p[1]: p[2] for p in parts.unpack("x", fx._package(1, "t", "en", "s"))} | {"word/document.xml": f"<w:document {fx.NS}><w:body>{body}</w:body></w:document>".encode()}
    files = spark.createDataFrame([("/a.docx", bytearray(parts.pack(list(package.items()))))], "path string, content binary")
    found = parts.scan_elements(files).selectExpr("1L AS doc_id", "seq AS pos", "type", "element_id", "footnote_id", "text", "empty")
    changes = [{"element_id": e, "old": o, "new": n} for e, o, n in (("table_1_cell_1_1", "part", "half"), ("table_1_cell_1_1", "first", "1st"), ("table_1_cell_1_2", "one two", "across"), ("table_1_cell_1_2", "two", "2"))]
    done = review.review(found, FixedSuggester(changes), "policy")
    assert {(r["change_no"], r["verdict"], r["par_no"]) for r in done.verdicts.collect()} == {(1, "exact", 1), (2, "exact", 0), (3, "fuzzy", 0), (4, "exact", 1)}
    got = px.edit_packages(files, review.package_edits(done, F.lit("/a.docx")), "simple").first()
    assert sorted(got["applied"]) == [1, 2, 3, 4] and not got["failed"]
    document = {p[1]: p[2] for p in parts.unpack("x", bytes(got["content"]))}["word/document.xml"].decode()
    assert sum(1 for _ in parts.parse_xml(document.encode()).iter(f"{parts.W}p")) == 5
    for text in ("1st ", "words ", "second ", "half ", "2 "):
        assert f">{text}<" in document


def test_every_kind_is_reviewed_and_edited(spark):
    from quillmill.operators import package_xml as px
    from quillmill.sources import parts

    files = spark.createDataFrame([("/a.docx", bytearray(fx._package(1, "one the\na the | b", "the box", "the head")))], "path string, content binary")
    found = parts.scan_elements(files).selectExpr("1L AS doc_id", "seq AS pos", "type", "element_id", "footnote_id", "text", "empty")
    done = review.review(found, review.RuleSuggester({"the": "an"}), "policy")
    note = done.verdicts.filter("route = 'footnote'").join(done.segments, ["doc_id", "change_no"]).orderBy("ord")
    assert [(r["kind"], r["val"]) for r in note.collect()] == [("strike", "note of the box"), ("insert", "an")]
    assert {(r["element_id"], r["verdict"]) for r in done.verdicts.collect()} == {(e, "exact") for e in ("paragraph_1", "table_1_cell_1_1", "header_1", "textbox_1", "footnote_1")}
    got = px.edit_packages(files, review.package_edits(done, F.lit("/a.docx")), "simple").first()
    assert len(got["applied"]) == 5 and not got["failed"]
    content = {p[1]: p[2].decode() for p in parts.unpack("x", bytes(got["content"]))}
    assert ">an <" in content["word/header1.xml"] and "FF0000" in content["word/header1.xml"]


def test_runs_of_whole_lines(spark):
    from quillmill.plans import queries

    d = "/root/testdata/sf0.001"
    lines = fx.lines(spark, d).collect()
    want = {(r["doc_id"], r["pos"]): " ".join(r["raw"].split()) for r in lines if r["raw"].split()}
    assert {(r["doc_id"], r["para_no"]): " ".join(r["text"].split()) for r in queries.concat_runs(spark, d).collect() if r["text"].strip()} == want


def test_rules_for_every_paragraph(spark):
    from quillmill.plans import queries

    d = "/root/testdata/sf0.001"
    every = el.paragraphs(fx.lines(spark, d)).select("doc_id", "seq", suggest.first_match(F.col("text"), fx.LEXICON)[0].alias("old")).filter("old IS NOT NULL")
    assert queries.suggest_rules(spark, d).count() == every.count() > 0


def test_only_highlights_are_compared(spark):
    rows = [(1, 1, k, 0.0, 0.0, 1.0, 1.0, "same", kind) for k, kind in enumerate((8, 1, 8, 1, None, 8))]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord int, x0 double, y0 double, x1 double, y1 double, content string, kind int")
    out = pdf.dedupe_notes(df)
    assert out.columns == df.columns and sorted(r["ord"] for r in out.collect()) == [0, 1, 3, 4]


def test_repairs_of_a_package():
    from xml.etree import ElementTree as ET

    from quillmill.operators import package_xml as px
    from quillmill.sources import parts

    W, ns = parts.W, fx.NS
    body = "<w:p><w:r><w:rPr><w:noProof/></w:rPr><w:t>a</w:t></w:r><w:proofErr/></w:p>" + '<w:p><w:pPr><w:pStyle w:val="Own"/></w:pPr><w:r><w:rPr><w:b/></w:rPr></w:r></w:p>' + "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>" + "<w:p/>" * 20
    package = {p[1]: p[2] for p in parts.unpack("x", fx._package(2, "t", "en", "s"))} | {"word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>".encode(), "word/theme/theme1.xml": b"<t/>"}
    fixed, done = px.repair(package)
    document, settings = ET.fromstring(fixed["word/document.xml"]), ET.fromstring(fixed["word/settings.xml"])
    assert not list(document.iter(f"{W}proofErr")) and not list(document.iter(f"{W}noProof")) and len(list(document.iter(f"{W}rPr"))) == 1
    styles = [s.get(f"{W}val") for s in document.iter(f"{W}pStyle")]
    assert styles.count("Normal") == 21 and styles.count("Own") == 1
    assert len(list(settings.iter(f"{W}rsid"))) == 100 and settings.find(f"{W}updateFields").get(f"{W}val") == "true" and settings.find(f"{W}compat") is not None
    assert b"rIdTheme" in fixed["word/_rels/document.xml.rels"] and "related theme/theme1.xml" in done
    assert px.repair(fixed) == (fixed, [])


def test_calls_over_all_tasks_keep_the_pause(spark):
    import time

    batches = spark.createDataFrame([(k, 0, [{"role": "user", "content": str(k)}]) for k in range(6)], "doc_id long, chunk_id long, messages array<struct<role:string,content:string>>")
    out = suggest.FunctionSuggester(lambda messages: repr(time.time()), 3, 0.4).replies(batches).collect()
    at = sorted(float(r["raw"]) for r in out)
    assert len(at) == 6 and at[-1] - at[0] > 0.4


def test_progress_is_told_and_may_fail(spark):
    elements = spark.createDataFrame([(1, 1, "paragraph", "paragraph_1", None, "the end", False)], "doc_id long, pos long, type string, element_id string, footnote_id string, text string, empty boolean")
    told = []

    def progress(message):
        told.append(message)
        raise ValueError("no listener")

    assert review.review(elements, review.RuleSuggester({"the": "an"}), "policy", progress=progress).verdicts.count() == 1
    assert told == ["1 batches", "1 batches asked, 0 failed"]


def test_scratch_leaves_no_rows(spark):
    from quillmill.session import fresh_path, scratch

    with scratch(spark):
        path = fresh_path(spark, "left")
        spark.range(1000).write.parquet(path)
        with scratch(spark):
            inner = fresh_path(spark, "inner")
            spark.range(5).write.parquet(inner)
        assert spark.read.parquet(inner).count() == 0 and spark.read.parquet(path).count() == 1000
    assert spark.read.parquet(path).count() == 0


def test_empty_tables(spark):
    elements = spark.createDataFrame([], ELEMENTS)
    changes = spark.createDataFrame([], CHANGES)
    assert match.verdicts(changes, elements).count() == 0
    assert batching.chunk_greedy(elements, F.length("text"), 1, 10, "seq").count() == 0
