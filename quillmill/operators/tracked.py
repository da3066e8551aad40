"""Coloured markup as tracked changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours of deletions and insertions; endings after which no blank is added.
RED, GREEN = "FF0000", "008000"
ENDINGS = (" ", ".", ",", ";", ":", "!", "?", "”", "’")


def change_kind(color: Column, strike: Column) -> Column:
    """``del`` for red struck runs, ``ins`` for green ones, null for others."""
    return F.when((color == RED) & strike, "del").when(color == GREEN, "ins")


def spaced(text: Column) -> Column:
    """With a blank at the end, unless the text ends in one or in punctuation."""
    ends = F.lit(False)
    for e in ENDINGS:
        ends = ends | text.endswith(e)
    return F.when(ends | (text == ""), text).otherwise(F.concat(text, F.lit(" ")))


def tracked_ids(runs: DataFrame) -> DataFrame:
    """Marked runs with ``kind`` and ``change_id`` 1, 2, 3, ... in the part's order."""
    kind = change_kind(F.col("color"), F.col("strike"))
    w = Window.partitionBy("doc_id", "part_name").orderBy("para_no", "run_no")
    return runs.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("change_id", F.row_number().over(w).cast("long"))


def tracked_segments(runs: DataFrame, motivations: bool = True) -> DataFrame:
    """(doc_id, part_name, para_no, run_no, change_id, kind, text, comment_ref) of the main part."""
    rows = tracked_ids(runs.filter(F.col("part_name") == "word/document.xml"))
    comment = F.col("comment_ref") if motivations else F.lit(None).cast("string")
    return rows.select("doc_id", "part_name", "para_no", "run_no", "change_id", "kind", spaced(F.col("text")).alias("text"), comment.alias("comment_ref"))


def paragraph_groups(paragraphs: DataFrame, size: int = 3) -> DataFrame:
    """Paragraphs (doc_id, para_no) in groups of ``size`` with an id made from document and group."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_no"))
    group = F.floor((n - 1) / size).cast("long")
    return paragraphs.withColumn("group_no", group).withColumn("rsid", F.upper(F.substring(F.sha2(F.concat_ws(":", "doc_id", "group_no"), 256), 1, 8)))
