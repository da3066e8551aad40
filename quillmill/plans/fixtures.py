"""Inputs of the review operators, derived from the driver's tables.

Each fixture has a SQL twin of the same name in ``SQL`` (a common table
expression for DuckDB), so that both sides start from the same rows. All of
them cover their whole table: every paragraph with a word of the lexicon has a
change, every line its words as runs, every block a note.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm, split_words
from ..operators import package
from ..operators.suggest import first_match
from ..sources import elements as el
from ..sources.parts import pack

#: Words that the rule-based suggester replaces.
LEXICON = {"the": "a", "of": "from", "der": "ein", "que": "quien", "le": "un", "and": "plus", "und": "sowie"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return el.lines(docs(spark, d))


def sections(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("kind"), F.lit(1).alias("pos"), c.alias("raw")) for s, k, c in ((0, "header", F.col("source")), (0, "footer", F.col("lang")), (1, "header", F.lit("second section")))])
    return docs(spark, d).select("doc_id", F.inline(rows))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter("pos % 9 = 0")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Raw notes; the first two of a document are separators."""
    return lines(spark, d).filter("pos % 10 = 0").withColumn("note_id", (F.floor(F.col("pos") / 10) - 2).cast("string"))


def elements(spark: SparkSession, d: str) -> DataFrame:
    note = lambda x: F.when(x["pos"] % 10 == 0, (F.floor(x["pos"] / 10) - 2).cast("string"))
    return el.from_documents(docs(spark, d), "text", "source", "lang", lambda x: x["pos"] % 9 == 0, note)


def elements_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """The same from the scans of each kind, as sources with a table per kind give them."""
    rows = lines(spark, d)
    return el.union([el.paragraphs(rows), el.table_cells(rows), el.header_footer(sections(spark, d)), el.numbered(boxes(spark, d), "textbox"), el.footnotes(notes(spark, d))])


def changes(spark: SparkSession, d: str) -> DataFrame:
    """A suggestion for every paragraph with a word of the lexicon (exact, nearly equal and absent old texts in turn), and planted odd ones per document."""
    rows = el.paragraphs(lines(spark, d)).withColumn("pos", F.col("seq"))
    old, new = first_match(F.col("text"), LEXICON)
    n = norm(F.col("text"))
    made = rows.withColumn("w", old).withColumn("r", new).filter("w IS NOT NULL").select(
        "doc_id",
        F.col("pos").alias("change_no"),
        "element_id",
        F.lit(None).cast("string").alias("footnote_id"),
        F.when(F.col("pos") % 3 == 1, F.col("w")).when(F.col("pos") % 3 == 2, F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("#"))).otherwise(F.concat(F.lit("zzzz "), "w")).alias("old"),
        F.when(F.col("pos") % 3 == 2, "rewritten").otherwise(F.col("r")).alias("new"),
        F.when(F.col("pos") % 2 == 1, "plain language").alias("motivation"),
    )
    s = lambda x: F.lit(x).cast("string")
    planted = [  # (modulus of doc_id, element, footnote, old, new, motivation)
        (1, "paragraph_99999", None, "the", "a", "unknown"),
        (3, None, None, "the", "a", None),
        (4, "header_1", None, "src", "source", "names"),
        (5, "footnote_1", "1", "x", "a new note", "notes"),
        (6, "textbox_1", None, "the", "a box", None),
        (7, "table_1_cell_1_1", None, "zz", "y", "cells"),
        (8, "comment_1", None, "the", "a", "kinds"),
        (9, "paragraph_1", None, None, "a", "no old"),
        (11, "paragraph_1", None, "12", "13", ""),
    ]
    items = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(1_000_000 + k).cast("long").alias("change_no"), s(e).alias("element_id"), s(f).alias("footnote_id"), s(o).alias("old"), s(w).alias("new"), s(why).alias("motivation")) for k, (m, e, f, o, w, why) in enumerate(planted)])
    extra = docs(spark, d).select("doc_id", F.inline(items)).filter("doc_id % m = 0").drop("m")
    return made.unionByName(extra)


def cell_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Cells cut into paragraphs after commas."""
    cells = el.table_cells(lines(spark, d))
    return cells.select("doc_id", "element_id", F.posexplode(F.split("text", ", ")).alias("par_no", "text")).withColumn("par_no", F.col("par_no").cast("long"))


def cell_changes(spark: SparkSession, d: str) -> DataFrame:
    """A change per cell: a word of it, or the cell with another last letter, or a short one."""
    cells = el.table_cells(lines(spark, d)).filter("NOT empty")
    t = F.col("text")
    old = F.when(F.col("seq") % 3 == 0, F.get(split_words(t), F.lit(0))).when(F.col("seq") % 3 == 1, F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("#"))).otherwise("12")
    return cells.select("doc_id", F.col("seq").alias("change_no"), "element_id", old.alias("old"), F.lit("new").alias("new"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Twenty lines a page, some blank."""
    pos = F.col("pos") - 1
    page, at = F.floor(pos / 20) + 1, pos % 20
    y = (at * 10).cast("double")
    return lines(spark, d).select("doc_id", page.cast("int").alias("page"), F.col("pos").cast("int").alias("ord"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 9).alias("y1"), F.when(F.col("pos") % 13 == 0, "  ").otherwise(F.col("raw")).alias("text"))


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).groupBy("doc_id").agg(F.max("page").alias("n_pages"))


def pdf_changes(spark: SparkSession, d: str) -> DataFrame:
    """A change of every line of three words or more: named by the right line, one that is off by one to three, or none; some on no page."""
    p = F.col("pos")
    first = F.array_join(F.slice(split_words(F.col("raw")), 1, 3), " ")
    line = ((p - 1) % 20 + 1 + F.floor(p / 6) % 4).cast("int")
    page = F.when(p % 5 == 1, None).when(p % 7 == 1, 0).when(p % 9 == 1, 999).otherwise(F.floor((p - 1) / 20) + 1).cast("int")
    return lines(spark, d).filter((F.size(split_words(F.col("raw"))) >= 3)).select(
        "doc_id",
        p.alias("change_no"),
        page.alias("page"),
        F.when(p % 3 != 1, line).alias("line"),
        F.when(p % 11 != 1, first).alias("old"),
        F.when(p % 2 == 1, F.concat(F.lit("rewrite "), p.cast("string"))).otherwise("").alias("new"),
        F.when(p % 4 == 1, "why").alias("motivation"),
    )


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """A note on every block, crowded so that some repeat."""
    b = blocks(spark, d)
    o = F.col("ord")
    x, y = (50 + (o % 3) * 4.9).cast("double"), (F.floor(o / 2) * 5.0).cast("double")
    return b.select("doc_id", "page", "ord", x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 9).alias("y1"), F.when(o % 7 == 0, "same").otherwise(F.concat(F.lit(" note "), o.cast("string"))).alias("content"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """The words of each line as runs."""
    words = lines(spark, d).select("doc_id", F.col("pos").cast("int").alias("para_no"), F.posexplode(split_words(F.col("raw"))).alias("run_no", "text"))
    k = (F.col("para_no") + F.col("run_no")) % 7
    part = F.when(F.col("para_no") % 11 == 0, "word/footnotes.xml").otherwise("word/document.xml")
    return words.select("doc_id", part.alias("part_name"), "para_no", "run_no", F.when(k.isin(0, 2), "FF0000").when(k == 1, "008000").alias("color"), F.when(k == 0, True).when(k == 2, False).alias("strike"), "text", F.when(F.col("run_no") % 5 == 0, F.col("run_no").cast("string")).alias("comment_ref"), F.when(F.col("run_no") % 6 == 5, F.concat(F.lit("f"), F.col("run_no").cast("string"))).alias("footnote_ref"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as replies: fenced and plain arrays, prose, an object, an empty array, a page that is no number, a failure."""
    clean = F.regexp_replace("text", "[^A-Za-z ]", "")
    item = lambda page: F.concat(F.lit('{"element_id": "paragraph_1", "page": '), F.lit(page), F.lit(', "old": "'), F.substring(clean, 1, 20), F.lit('", "new": "x"}'))
    array = F.concat(F.lit("["), item("1"), F.lit(", "), item("2"), F.lit("]"))
    t = F.col("turn") % 7
    raw = F.when(t == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(t == 1, array).when(t == 2, clean).when(t == 3, item("1")).when(t == 4, " [] ").when(t == 5, F.concat(F.lit("["), item('"seven"'), F.lit("]"))).otherwise(F.concat(F.lit("```\n"), array, F.lit("```")))
    conv = table(spark, d, "conversations")
    return conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("chunk_id"), (F.col("conv_id") % 10 != 9).alias("ok"), raw.alias("raw"))


def _kept(spark: SparkSession, d: str, values: tuple, name: str, modulus: int) -> DataFrame:
    """(doc_id, name): each value but for the documents where (doc_id + its number) is a multiple."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias(name)) for k, v in enumerate(values)])
    return docs(spark, d).select("doc_id", F.inline(rows)).filter(f"(doc_id + k) % {modulus} <> 0").drop("k")


#: Style ids of the fixture; some are Swedish.
STYLE_IDS = ("Standard", "Standardstycketeckensnitt", "TableNormal", "CommentText", "InsertedText", "DeletedText", "Rubrik1", "Own")
PART_NAMES = ("word/document.xml", "word/_rels/document.xml.rels", "word/styles.xml", "word/settings.xml", "word/comments.xml", "word/people.xml", "[Content_Types].xml")
TARGETS = ("styles.xml", "/word/settings.xml", "comments.xml", "fontTable.xml", "webSettings.xml", "media/image1.png")
SETTINGS = ("trackRevisions", "zoom", "compat")


def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id")


def styles(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, STYLE_IDS, "style_id", 5)


def parts(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, PART_NAMES, "part_name", 9).withColumn("content", F.concat_ws(":", F.lit("target"), "doc_id", "part_name"))


def source_parts(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, (*package.MERGED_PARTS, "customXml/item1.xml", "word/other.xml"), "part_name", 4).withColumn("content", F.concat_ws(":", F.lit("source"), "doc_id", "part_name"))


def rels(spark: SparkSession, d: str) -> DataFrame:
    kept = _kept(spark, d, TARGETS, "target", 6)
    number = F.array_position(F.array(*[F.lit(t) for t in TARGETS]), F.col("target"))
    return kept.withColumn("rid", F.concat(F.lit("rId"), number + F.col("doc_id") % 2))


def settings(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, SETTINGS, "name", 3)


def overrides(spark: SparkSession, d: str) -> DataFrame:
    kept = _kept(spark, d, tuple(p for p, _ in package.COMMENT_OVERRIDES) + ("/word/document.xml",), "part_name", 2)
    return kept.withColumn("content_type", F.lit("present"))


def comments(spark: SparkSession, d: str) -> DataFrame:
    """A comment for every label, by document id; ids that are no integer for every seventh."""
    labels = table(spark, d, "labels")
    return labels.select((F.col("doc_id") % 50).alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("comment_id"), F.lit("text").alias("text"))


def comment_refs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").cast("string").alias("comment_id"))


def rsids(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", (F.col("pos") % 15).cast("string").alias("rsid"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """A run-property node per run with one or two children, some of them proofing marks."""
    base = runs(spark, d).select("doc_id", (F.col("para_no").cast("long") * 1_000_000 + F.col("run_no")).alias("n"))
    two = F.when(F.col("n") % 3 == 0, 2).otherwise(1)
    items = F.array(
        F.struct((F.col("n") * 10).alias("node"), F.lit(-1).cast("long").alias("parent"), F.lit("rPr").alias("tag"), two.cast("long").alias("n_children")),
        F.struct((F.col("n") * 10 + 1).alias("node"), (F.col("n") * 10).alias("parent"), F.when(F.col("n") % 2 == 0, "noProof").otherwise("b").alias("tag"), F.lit(0).cast("long").alias("n_children")),
        F.struct((F.col("n") * 10 + 2).alias("node"), (F.col("n") * 10).alias("parent"), F.when(F.col("n") % 4 == 0, "proofErr").otherwise("i").alias("tag"), F.lit(0).cast("long").alias("n_children")),
    )
    return base.withColumn("two", two).select("doc_id", "two", F.posexplode(items).alias("k", "x")).filter("k <= two").select("doc_id", "x.*")


def styled_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", F.col("pos").alias("para_no"), F.when(F.col("pos") % 3 != 0, "Own").alias("style"), (F.col("pos") % 5 != 0).alias("body"))


def job_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("event_type").isin("purchase", "signup").alias("done"), F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), "event_id")).alias("error"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Results of every third user, and of jobs that nobody knows."""
    e = table(spark, d, "events").select("user_id", "event_id")
    return e.filter("user_id % 3 = 0").select(F.col("user_id").alias("job_id")).union(e.filter("event_id % 100 = 0").select((F.col("event_id") + 10_000_000).alias("job_id"))).distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in (".docx", ".PDF", ".txt", "", ".Docx")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.concat(F.lit("/up.d/file"), F.col("event_id").cast("string"), kind).alias("path"), F.col("ts").alias("modificationTime"))


def policies(spark: SparkSession, d: str) -> DataFrame:
    """A policy per document around its first line; every fourth lacks a marker."""
    first = lines(spark, d).filter("pos = 1")
    end = F.when(F.col("doc_id") % 4 == 0, "").otherwise("<!-- END_EDITABLE -->")
    text = F.concat(F.lit("<!-- START_LOCKED -->\n\nBefore "), F.col("doc_id").cast("string"), F.lit("\n<!-- END_LOCKED -->\n\n<!-- START_EDITABLE -->\n "), "raw", F.lit("\n"), end, F.lit("\n<!-- START_LOCKED -->\nAfter\n<!-- END_LOCKED -->\n"))
    return first.select("doc_id", text.alias("text"))


def edit_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of an edit per paragraph: words kept, struck, inserted in turn."""
    r = runs(spark, d)
    k = (F.col("para_no") + F.col("run_no")) % 5
    return r.select("doc_id", F.col("para_no").cast("long").alias("change_no"), F.col("run_no").alias("ord"), F.when(k == 3, "strike").when(k == 4, "insert").otherwise("text").alias("kind"), F.concat("text", F.lit(" ")).alias("val"))


def edit_refs(spark: SparkSession, d: str) -> DataFrame:
    """Two footnote references per paragraph, at characters 10 and 45."""
    rows = F.array(*[F.struct(F.lit(i).alias("ref_id"), F.lit(o).cast("long").alias("off")) for i, o in (("f1", 10), ("f2", 45))])
    return lines(spark, d).select("doc_id", F.col("pos").alias("change_no"), F.inline(rows))



#: Characters that the packages leave out.
ILLEGAL = re.compile("[^\t\n -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _package(doc_id: int, text: str, lang: str, source: str) -> bytes:
    """A document as an office package: lines as paragraphs, or as table rows where they hold pipes."""
    from xml.sax.saxutils import escape

    legal = ILLEGAL.sub("", text)
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    rows = legal.split("\n")
    body = "".join(f"<w:p>{run(x)}</w:p>" for x in rows if " | " not in x)
    cells = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in x.split(" | ")) + "</w:tr>" for x in rows if " | " in x)
    table = f"<w:tbl>{cells}</w:tbl>" if cells else ""
    drawing = f"<w:p><w:r><w:drawing><w:txbxContent><w:p>{run(lang)}</w:p></w:txbxContent></w:drawing></w:r><w:r><w:commentReference w:id=\"{doc_id % 3}\"/></w:r></w:p>"
    section = '<w:sectPr><w:headerReference w:type="default" r:id="rId1"/></w:sectPr>'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="main"/></Types>',
        "word/document.xml": f"<w:document {NS}><w:body>{body}{table}{drawing}{section}</w:body></w:document>",
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="header" Target="header1.xml"/></Relationships>',
        "word/header1.xml": f"<w:hdr {NS}><w:p>{run(source or '')}</w:p></w:hdr>",
        "word/styles.xml": f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="Standard"><w:name w:val="Normal"/></w:style></w:styles>',
        "word/settings.xml": f"<w:settings {NS}>" + ("<w:trackRevisions/>" if doc_id % 2 else "") + "</w:settings>",
        "word/comments.xml": f'<w:comments {NS}><w:comment w:id="0" w:author="a"><w:p>{run("c")}</w:p></w:comment></w:comments>',
        "word/footnotes.xml": f'<w:footnotes {NS}><w:footnote w:id="-1"/><w:footnote w:id="0"/><w:footnote w:id="7"><w:p>{run("note of " + lang)}</w:p></w:footnote></w:footnotes>',
    }
    if doc_id % 50 == 49:
        parts["word/broken.xml"] = "<open>"
    return pack([(k, v.encode()) for k, v in parts.items()])


def packages(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): every document as a package; each hundredth file is cut short."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for i, text, lang, source in zip(frame["doc_id"], frame["text"], frame["lang"], frame["source"]):
                data = _package(i, text or "", lang or "", source or "")
                rows.append((f"/in/doc{i}.docx", data[: len(data) // 2] if i % 100 == 99 else data))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return docs(spark, d).mapInPandas(run, "path string, content binary")
