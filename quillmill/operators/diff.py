"""Segments of an edit: kept, struck and inserted words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udfs import word_diff
from ..schemas import SEGMENTS
from .match import replacement


def diff_words(rows: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Adds ``segments``: the word diff of two columns."""
    return rows.withColumn("segments", word_diff(old, new))


def diff_paragraph(rows: DataFrame) -> DataFrame:
    """The whole paragraph against its replaced text."""
    return diff_words(replacement(rows), "text", "result")


def diff_footnote(baseline: Column, new: Column) -> Column:
    """A note is replaced as a whole: struck baseline, inserted new text."""
    part = lambda n, kind, c: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), F.coalesce(c, F.lit("")).alias("val"))
    return F.array(part(0, "strike", baseline), part(1, "insert", new)).cast(SEGMENTS)


def explode_segments(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.inline("segments"))


def run_offsets(runs: DataFrame) -> DataFrame:
    """Runs with ``offset``: characters of the paragraph before them."""
    w = Window.partitionBy("doc_id", "para_no").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("offset", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long"))


def footnote_slots(segments: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, change_no, ref_id, slot): the first segment at whose end the baseline is as long as the reference's offset.

    segments: doc_id, change_no, ord, kind, val; refs: doc_id, change_no, ref_id, off. Inserted words are no
    baseline. A reference behind all text gets a null slot (the end).
    """
    w = Window.partitionBy("doc_id", "change_no").orderBy("ord")
    grown = segments.withColumn("so_far", F.sum(F.when(F.col("kind") == "insert", 0).otherwise(F.length("val"))).over(w))
    slots = refs.join(grown, ["doc_id", "change_no"]).filter("so_far >= off").groupBy("doc_id", "change_no", "ref_id", "off").agg(F.min("ord").cast("long").alias("slot"))
    return refs.join(slots, ["doc_id", "change_no", "ref_id", "off"], "left")


def anchor_positions(runs: DataFrame) -> DataFrame:
    """(doc_id, para_no, footnote_ref, after_run): a comment goes behind the run that follows the reference, or behind the reference if none does."""
    nxt = F.lead("run_no").over(Window.partitionBy("doc_id", "para_no").orderBy("run_no"))
    return runs.withColumn("nxt", nxt).filter("footnote_ref IS NOT NULL").select("doc_id", "para_no", "footnote_ref", F.coalesce("nxt", "run_no").cast("long").alias("after_run"))


def concat_runs(runs: DataFrame, separator: str = "") -> DataFrame:
    """Text of each paragraph from its runs, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"]), separator)
    return runs.groupBy("doc_id", "para_no").agg(joined.alias("text"))
