"""Rules over the parts of office packages: validation, repair, quality report.

A rule is a query that gives (doc_id, rule, severity, detail); a repair is a
rewrite of the same tables: what is required and not there is added, what
refers to nothing is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a package must have.
REQUIRED_STYLES = ("Normal", "DefaultParagraphFont", "TableNormal", "CommentText", "InsertedText", "DeletedText")
REQUIRED_TARGETS = ("styles.xml", "settings.xml", "comments.xml", "fontTable.xml", "webSettings.xml")
MERGED_PARTS = ("word/styles.xml", "word/settings.xml", "word/fontTable.xml", "word/webSettings.xml", "word/_rels/document.xml.rels", "word/theme/theme1.xml")
COMMENT_PARTS = ("word/commentsExtended.xml", "word/commentsIds.xml", "word/people.xml")
COMMENT_RELATIONSHIPS = (
    ("commentsExtended.xml", "http://schemas.microsoft.com/office/2011/relationships/commentsExtended", "rIdExt"),
    ("commentsIds.xml", "http://schemas.microsoft.com/office/2016/09/relationships/commentsIds", "rIdIds"),
    ("people.xml", "http://schemas.openxmlformats.org/officeDocument/2006/relationships/person", "rIdPeople"),
)
COMMENT_OVERRIDES = (
    ("/word/commentsExtended.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.commentsExtended+xml"),
    ("/word/commentsIds.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.commentsIds+xml"),
    ("/word/people.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.people+xml"),
)
TRACK_FLAG = "trackRevisions"
THEME = ("theme/theme1.xml", "http://schemas.openxmlformats.org/officeDocument/2006/relationships/theme", "rIdTheme")
#: Children of a node table that clean-up removes.
REMOVED_TAGS = ("proofErr", "noProof")
SPARSE_RSIDS = 10

# Swedish style ids and the names that they stand for.
STYLE_NAMES = {
    "Standard": "Normal",
    "Standardstycketeckensnitt": "DefaultParagraphFont",
    "Normaltabell": "TableNormal",
    "Rubrik": "Title",
    **{f"Rubrik{n}": f"heading {n}" for n in range(1, 10)},
    "Underrubrik": "Subtitle",
    "Brödtext": "Body Text",
    "Fotnotstext": "footnote text",
    "Sidhuvud": "header",
    "Sidfot": "footer",
    "Citat": "Quote",
    "Ballongtext": "Balloon Text",
    "Beskrivning": "caption",
    "Slutkommentar": "endnote text",
    "Tabellrubrik": "Table Heading",
    **{f"Innehåll{n}": f"toc {n}" for n in range(1, 4)},
    "Innehållsförteckningsrubrik": "TOC Heading",
    **{f"Rubrik{n}Char": f"heading {n} Char" for n in range(1, 10)},
    "RubrikChar": "Title Char",
    "UnderrubrikChar": "Subtitle Char",
    "BrdtextChar": "Body Text Char",
    "BallongtextChar": "Balloon Text Char",
    "Doldtext": "Hidden Text",
    "Hyperlnk": "Hyperlink",
    "FotnotstextChar": "Footnote Text Char",
    "SlutkommentarChar": "Endnote Text Char",
    "SidhuvudChar": "Header Char",
    "SidfotChar": "Footer Char",
    "CitatChar": "Quote Char",
    "Platshållartext": "Placeholder Text",
    "Ingenlista": "No List",
    "Punktlista": "List Bullet",
    **{f"Punktlista{n}": f"List Bullet {n}" for n in (2, 3)},
    "Numreradlista": "List Number",
    **{f"Numreradlista{n}": f"List Number {n}" for n in (2, 3)},
    "Sidnummer": "page number",
    "Tabellrutnät": "Table Grid",
    "IAF": "TableNormal",
    "IAFBlåkolumn": "Table Colorful 1",
}


def names(spark: SparkSession) -> DataFrame:
    """The style names as a table; it has as many rows as the constant above."""
    return spark.createDataFrame(list(STYLE_NAMES.items()), "style_id string, name string")


def translate_styles(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id) with ``name``: the canonical one, or the id itself."""
    return styles.join(F.broadcast(names(styles.sparkSession)), "style_id", "left").withColumn("name", F.coalesce("name", "style_id"))


def _required(docs: DataFrame, values: tuple, column: str) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


def missing(docs: DataFrame, required: tuple, present: DataFrame, column: str) -> DataFrame:
    """(doc_id, column): required values that a document (of ``docs``) lacks."""
    return _required(docs, required, column).join(present.select("doc_id", column), ["doc_id", column], "left_anti")


def missing_styles(docs: DataFrame, styles: DataFrame) -> DataFrame:
    """Required styles that a document lacks after translation."""
    present = translate_styles(styles).select("doc_id", F.col("name").alias("style"))
    return missing(docs, REQUIRED_STYLES, present, "style")


def missing_targets(docs: DataFrame, rels: DataFrame) -> DataFrame:
    """Required targets that no relationship's target of the document contains."""
    want = _required(docs, REQUIRED_TARGETS, "target").alias("w")
    have = rels.select(F.col("doc_id").alias("d"), F.col("target").alias("t"))
    return want.join(have, (F.col("doc_id") == F.col("d")) & F.col("t").contains(F.col("target")), "left_anti")


def orphan_references(refs: DataFrame, comments: DataFrame) -> DataFrame:
    """Comment references (doc_id, comment_id) without a comment."""
    return refs.join(comments.select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti")


def with_missing_comments(comments: DataFrame, refs: DataFrame, text: str = "(missing comment)") -> DataFrame:
    """Comments (doc_id, comment_id, text), and one with ``text`` per reference that has none."""
    made = orphan_references(refs.select("doc_id", "comment_id").distinct(), comments).withColumn("text", F.lit(text)).withColumn("made", F.lit(True))
    return comments.withColumn("made", F.lit(False)).unionByName(made)


def next_comment_id(comments: DataFrame) -> DataFrame:
    """One above the largest integer id of a document; 0 without any."""
    return comments.groupBy("doc_id").agg((F.coalesce(F.max(F.col("comment_id").try_cast("bigint")), F.lit(-1)) + 1).alias("next_id"))


def first_free_rid(rels: DataFrame) -> DataFrame:
    """The smallest ``rIdN``, N from 1, that a document does not use. One of the first count + 1 is free."""
    used = F.array_distinct(F.collect_list("rid"))
    free = F.filter(F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda n: F.concat(F.lit("rId"), n)), lambda r: ~F.array_contains(used, r))
    return rels.groupBy("doc_id").agg(F.element_at(free, 1).alias("free_rid"))


def add_if_absent(target: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and the rows of ``required`` whose keys it lacks, flagged ``added``."""
    fresh = required.join(target.select(*keys).distinct(), keys, "left_anti")
    return target.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def required_overrides(docs: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("part_name"), F.lit(t).alias("content_type")) for p, t in COMMENT_OVERRIDES])
    return docs.select("doc_id", F.inline(rows))


def required_relationships(docs: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(y).alias("type"), F.lit(i).alias("rid")) for t, y, i in COMMENT_RELATIONSHIPS])
    return docs.select("doc_id", F.inline(rows))


def theme_relationship(parts: DataFrame) -> DataFrame:
    """The relationship that a document with a theme part needs; for ``add_if_absent``."""
    target, kind, rid = THEME
    return parts.filter(F.col("part_name") == f"word/{target}").select("doc_id", F.lit(target).alias("target"), F.lit(kind).alias("type"), F.lit(rid).alias("rid"))


def merge_missing_parts(target: DataFrame, source: DataFrame) -> DataFrame:
    """Parts (doc_id, part_name, content): the target's, and of the required ones and customXml/ those that only the source has."""
    wanted = source.filter(F.col("part_name").isin(*MERGED_PARTS) | F.col("part_name").startswith("customXml/"))
    return add_if_absent(target, wanted, ["doc_id", "part_name"])


def rsid_bucket(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs of a document, and the number of revision ids that go with that."""
    n = F.col("n_paragraphs")
    return paragraphs.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs")).withColumn("n_rsids", F.when(n < 20, 50).when(n < 100, 100).otherwise(200).cast("long"))


def default_style(paragraphs: DataFrame, default: str = "Normal") -> DataFrame:
    """Body paragraphs without a style get the default one; ``fixed`` tells which."""
    lacks = F.col("style").isNull() & F.col("body")
    return paragraphs.withColumn("fixed", lacks).withColumn("style", F.when(lacks, F.lit(default)).otherwise(F.col("style")))


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, node, parent, tag, n_children) without proofing marks and without run properties that are, or thereby become, empty."""
    gone = F.col("tag").isin(*REMOVED_TAGS)
    dropped = nodes.filter(gone).groupBy("doc_id", F.col("parent").alias("node")).agg(F.count("*").alias("lost"))
    rest = nodes.filter(~gone).join(dropped, ["doc_id", "node"], "left")
    return rest.filter((F.col("tag") != "rPr") | (F.col("n_children") > F.coalesce("lost", F.lit(0)))).drop("lost")


def repair_plan(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, step, action): the repairs of a package in their order.

    The order matters: references without a comment are dropped before dummy
    comments would be made for them.
    """
    have = parts.groupBy("doc_id").agg(F.collect_set("part_name").alias("have"))
    lacks = lambda name: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), name)
    steps = [
        (1, "create word/comments.xml", lacks("word/comments.xml")),
        *[(2, f"create {p}", lacks(p)) for p in COMMENT_PARTS],
        (3, "add comment relationships", ~lacks("word/_rels/document.xml.rels")),
        (4, "add comment overrides", ~lacks("[Content_Types].xml")),
        (5, "drop orphan comment references", ~lacks("word/document.xml")),
        (6, "add track flag and rsids", ~lacks("word/settings.xml")),
        (7, "create word/styles.xml", lacks("word/styles.xml")),
        (8, "add required styles", F.lit(True)),
    ]
    rows = F.filter(F.array(*[F.struct(F.lit(n).cast("long").alias("step"), F.lit(a).alias("action"), c.alias("due")) for n, a, c in steps]), lambda x: x["due"])
    return docs.select("doc_id").join(have, "doc_id", "left").select("doc_id", F.inline(rows)).drop("due")


def finding(df: DataFrame, rule: str, severity: str, detail: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail"))


def validate(docs: DataFrame, parts: DataFrame, rels: DataFrame, styles: DataFrame, settings: DataFrame, comments: DataFrame, refs: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """All findings of all packages; ``docs`` holds doc_id once each.

    parts (doc_id, part_name), rels (doc_id, target), styles (doc_id, style_id), settings (doc_id, name),
    comments and refs (doc_id, comment_id), malformed (doc_id, part_name, error).
    """

    def without(name):
        return docs.join(parts.filter(F.col("part_name") == name).select("doc_id"), "doc_id", "left_anti")

    def having(name):
        return docs.join(parts.filter(F.col("part_name") == name).select("doc_id"), "doc_id", "left_semi")

    rels_part, styles_part, settings_part = "word/_rels/document.xml.rels", "word/styles.xml", "word/settings.xml"
    found = [
        finding(without(rels_part), "relationships", "error", F.lit("missing document.xml.rels")),
        finding(missing_targets(having(rels_part), rels), "relationships", "warning", F.concat(F.lit("missing relationship to "), "target")),
        finding(without(styles_part), "styles", "error", F.lit("missing styles.xml")),
        finding(missing_styles(having(styles_part), styles), "styles", "warning", F.concat(F.lit("missing style "), "style")),
        finding(without(settings_part), "settings", "error", F.lit("missing settings.xml")),
        finding(having(settings_part).join(settings.filter(F.col("name") == TRACK_FLAG).select("doc_id"), "doc_id", "left_anti"), "settings", "warning", F.lit("missing trackRevisions")),
        finding(orphan_references(refs, comments).join(having("word/comments.xml"), "doc_id", "left_semi"), "comments", "warning", F.concat(F.lit("no comment for reference "), "comment_id")),
    ]
    if malformed is not None:
        found.append(finding(malformed, "wellformed", "error", F.concat("part_name", F.lit(": "), "error")))
    return reduce(DataFrame.unionByName, found)


def check_settings(docs: DataFrame, parts: DataFrame, settings: DataFrame) -> DataFrame:
    """(doc_id, detail) for packages without settings, or without the track flag in them."""
    part = parts.filter(F.col("part_name") == "word/settings.xml").select("doc_id", F.lit(True).alias("there")).distinct()
    flag = settings.filter(F.col("name") == TRACK_FLAG).select("doc_id", F.lit(True).alias("flag")).distinct()
    rows = docs.join(part, "doc_id", "left").join(flag, "doc_id", "left")
    return rows.withColumn("detail", F.when(F.col("there").isNull(), "missing settings.xml").when(F.col("flag").isNull(), "missing trackRevisions")).filter("detail IS NOT NULL").select("doc_id", "detail")


def qc_report(docs: DataFrame, styles: DataFrame, settings: DataFrame, rsids: DataFrame) -> DataFrame:
    """(doc_id, n_missing_styles, track_revisions, n_rsids, sparse_rsids). A package without styles lacks all of them."""
    lacking = missing(docs, REQUIRED_STYLES, styles.select("doc_id", F.col("style_id").alias("style")), "style").groupBy("doc_id").agg(F.count("*").alias("n_missing_styles"))
    flags = settings.filter(F.col("name") == TRACK_FLAG).groupBy("doc_id").agg(F.lit(True).alias("track_revisions"))
    ids = rsids.groupBy("doc_id").agg(F.count_distinct("rsid").alias("n_rsids"))
    rows = docs.join(lacking, "doc_id", "left").join(flags, "doc_id", "left").join(ids, "doc_id", "left")
    n = F.coalesce("n_rsids", F.lit(0)).cast("long")
    return rows.select("doc_id", F.coalesce("n_missing_styles", F.lit(0)).cast("long").alias("n_missing_styles"), F.coalesce("track_revisions", F.lit(False)).alias("track_revisions"), n.alias("n_rsids"), (n < SPARSE_RSIDS).alias("sparse_rsids"))


def paragraph_numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("para_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long"))
