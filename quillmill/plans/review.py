"""The review from elements to edits: batches, suggestions, matches, segments, a verdict for every change."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batching, diff, match, suggest
from ..session import fresh_path

log = logging.getLogger(__name__)

PREAMBLE = "Här är en del av dokumentet som ska granskas:"


@dataclass
class Review:
    """segments (doc_id, change_no, ord, kind, val), verdicts, rejects (doc_id, chunk_id, pos, reason, raw), summary per document."""

    segments: DataFrame
    verdicts: DataFrame
    rejects: DataFrame
    summary: DataFrame
    comments: DataFrame


class RuleSuggester:
    """Answers a batch with a change for each element that holds a word of the lexicon, as a model would: in JSON."""

    def __init__(self, lexicon: dict[str, str]):
        self.lexicon = lexicon

    def replies(self, batches: DataFrame) -> DataFrame:
        asked = F.regexp_extract(F.element_at("messages", 2)["content"], r"(?s)(\[.*\])", 1)
        items = F.from_json(asked, "array<struct<type:string,element_id:string,text:string>>")
        old, new = suggest.first_match(F.col("x.text"), self.lexicon)
        rows = batches.select("doc_id", "chunk_id", F.posexplode_outer(items).alias("pos", "x")).withColumn("old", old).withColumn("new", new)
        change = F.when(F.col("old").isNotNull(), F.struct("pos", F.struct(F.col("x.type").alias("type"), F.col("x.element_id").alias("element_id"), "old", "new", F.lit("plain language").alias("motivation")).alias("c")))
        listed = F.transform(F.array_sort(F.collect_list(change)), lambda x: x["c"])
        return rows.groupBy("doc_id", "chunk_id").agg(F.lit(True).alias("ok"), F.to_json(listed).alias("raw"))


def _report(progress, message: str) -> None:
    """Tell the caller; a callback that fails is logged and does not stop the review."""
    if progress is not None:
        try:
            progress(message)
        except Exception as e:
            log.warning("progress callback failed: %s", e)


def review(elements: DataFrame, suggester, prompt: str, max_tokens: int = batching.MAX_TOKENS, motivations: bool = True, progress: Callable[[str], None] | None = None) -> Review:
    """Review documents' elements (doc_id, pos, type, element_id, footnote_id, text, empty).

    ``progress`` is told, on the driver, when batches are made and when they are answered.

    Replies are written to the shared folder once: asking is the dear and
    unrepeatable step, everything after it reads that table.
    """
    spark = elements.sparkSession
    asked = batching.greedy_messages(elements, batching.element_length(), prompt, PREAMBLE, max_tokens)
    path = fresh_path(spark, "replies")
    if progress is not None:
        _report(progress, f"{asked.select('doc_id', 'chunk_id').count()} batches")
    suggester.replies(asked).write.parquet(path)
    if progress is not None:
        told = spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).first()
        _report(progress, f"{told['n']} batches asked, {told['n'] - told['ok']} failed")
    items, rejects = suggest.parse_replies(spark.read.parquet(path))
    changes = batching.concat_batches(items)
    verdicts = resolved(match.verdicts(changes, elements), elements)
    applied = verdicts.filter(F.col("verdict").isin("exact", "fuzzy"))
    segments = diff.explode_segments(_notes_whole(diff.diff_paragraph(applied)), "doc_id", "change_no")
    comments = changes.filter(match.comment_eligible(F.col("motivation"), F.col("element_id"), motivations)).select("doc_id", "change_no", "element_id", "motivation")
    return Review(segments, verdicts, rejects, match.summary(verdicts), comments)


def _notes_whole(rows: DataFrame) -> DataFrame:
    """Segments of footnotes are the whole note, struck and inserted."""
    note = F.col("element_id").startswith("footnote_")
    return rows.withColumn("segments", F.when(note, diff.diff_footnote(F.col("text"), F.col("result"))).otherwise(F.col("segments")))


def resolved(verdicts: DataFrame, elements: DataFrame) -> DataFrame:
    """Verdicts with the deferred ones decided by the joins of footnotes and text boxes.

    A footnote's change replaces the whole note, a text box's goes to the
    first box that holds its old text; both are ``exact``. What no join finds is no_match.
    """
    key = ["doc_id", "change_no"]
    verdicts = _in_cells(verdicts)
    deferred = verdicts.filter("verdict = 'deferred'")
    notes = elements.filter("type = 'footnote'")
    named = deferred.filter("route = 'footnote'").join(notes.select("doc_id", "element_id", "footnote_id"), ["doc_id", "element_id"])
    found = match.join_footnotes(named, notes).select(*key, F.col("element_id").alias("place"), F.col("baseline").alias("found"), F.col("baseline").alias("was"))
    boxes = elements.filter("type = 'textbox'").withColumn("seq", F.regexp_extract("element_id", r"\d+", 0).cast("long"))
    boxed = match.join_textboxes(deferred.filter("route = 'textbox'"), boxes).select(*key, F.col("box_id").alias("place"), F.col("box_text").alias("found"), F.col("old").alias("was"))
    rows = verdicts.join(found.union(boxed), key, "left")
    hit, open_ = F.col("place").isNotNull(), F.col("verdict") == "deferred"
    return rows.select("doc_id", "change_no", F.coalesce("place", "element_id").alias("element_id"), "route", F.when(hit, "exact").when(open_, "no_match").otherwise(F.col("verdict")).alias("verdict"), "score", F.coalesce("found", "text").alias("text"), F.coalesce("was", "old").alias("old"), "new", "par_no")


def _in_cells(rows: DataFrame) -> DataFrame:
    """``par_no`` and ``text`` of the paragraph that a change goes to: in a cell the first that holds its old text, else the first; elsewhere all is one."""
    cell = F.col("route") == "table_cell"
    at = F.when(cell, F.coalesce(match.paragraph_with(F.col("text"), F.coalesce("old", F.lit(""))), F.lit(0))).otherwise(0).cast("int")
    return rows.withColumn("par_no", at).withColumn("text", F.when(cell, F.get(F.split("text", "\n"), F.col("par_no"))).otherwise(F.col("text")))


def package_edits(done: Review, path) -> DataFrame:
    """Edits of packages (path, change_no, element_id, par_no, whole, changes): one per element, or paragraph of a cell.

    ``changes`` (change_no, old, new, motivation) are all accepted changes of
    the element, in order; the package that they go to holds its text, so
    `edit_packages` applies them there. ``path`` is a column expression over
    doc_id, ``change_no`` the first change's; ``whole`` notes are replaced as such.
    """
    accepted = done.verdicts.filter(F.col("verdict").isin("exact", "fuzzy")).join(done.comments.select("doc_id", "change_no", "motivation"), ["doc_id", "change_no"], "left")
    change = F.struct("change_no", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"), "motivation")
    groups = accepted.groupBy("doc_id", "element_id", "par_no").agg(F.array_sort(F.collect_list(change)).alias("changes"))
    return groups.select(path.alias("path"), F.col("changes")[0]["change_no"].alias("change_no"), "element_id", "par_no", F.col("element_id").startswith("footnote_").alias("whole"), "changes")
