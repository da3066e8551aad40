"""Suggested changes against a document's elements: one verdict per change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm, norm_box
from ..functions.udfs import replaced, replaced_all, similarity

#: Acceptance of fuzzy matches, shortest fuzzy candidate.
THRESHOLD, SHORTEST = 90, 4

ROUTES = ("paragraph", "table_cell", "footnote", "textbox", "unsupported")


def route(element_id: Column) -> Column:
    """Which editor an element belongs to. Headers and footers are edited as paragraphs."""
    cell = element_id.startswith("table_") & element_id.contains("_cell_")
    return (
        F.when(element_id.rlike("^(paragraph|header|footer)_"), "paragraph")
        .when(cell, "table_cell")
        .when(element_id.startswith("footnote_"), "footnote")
        .when(element_id.startswith("textbox_"), "textbox")
        .otherwise("unsupported")
    )


def known(changes: DataFrame, elements: DataFrame) -> DataFrame:
    """Changes whose element exists (a null id never does)."""
    return changes.join(elements.select("doc_id", "element_id"), ["doc_id", "element_id"], "left_semi")


def unknown(changes: DataFrame, elements: DataFrame) -> DataFrame:
    return changes.join(elements.select("doc_id", "element_id"), ["doc_id", "element_id"], "left_anti")


def with_elements(changes: DataFrame, elements: DataFrame) -> DataFrame:
    return changes.join(elements.select("doc_id", "element_id", F.col("type").alias("element_type"), "text"), ["doc_id", "element_id"])


def exact(text: Column, old: Column) -> Column:
    """Whether the old text occurs, whitespace runs being equal. An empty one always does."""
    return norm(text).contains(norm(old))


def paragraph_with(text: Column, old: Column) -> Column:
    """Which paragraph (line) of a cell's text holds the old text first, from 0; null if none does."""
    holds = F.transform(F.split(text, "\n"), lambda p: exact(p, old))
    at = F.array_position(holds, F.lit(True))
    return F.when(at > 0, at - 1)


def short_or_numeric(old: Column) -> Column:
    """Too little to match fuzzily: only digits, or under four characters."""
    n = norm(old)
    return n.rlike(r"^\p{Nd}+$") | (F.length(n) < SHORTEST)


def could_be_similar(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Upper bound of the similarity from lengths alone: cheap, and before any Python."""
    la, lb = F.length(a), F.length(b)
    return 200 * F.least(la, lb) >= (threshold - 0.5) * (la + lb)


def fuzzy(candidates: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows of (old, text, ...) with ``score`` at or above the threshold."""
    rows = candidates.withColumn("__a", norm(F.col("old"))).withColumn("__b", norm(F.col("text"))).filter(could_be_similar(F.col("__a"), F.col("__b"), threshold))
    return rows.withColumn("score", similarity("__a", "__b")).filter(F.col("score") >= threshold).drop("__a", "__b")


def verdicts(changes: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, change_no, element_id, route, verdict, score, text, old, new).

    A cell's old text is in one of its paragraphs; only nearly equal ones are
    compared with the whole cell. Verdicts: missing_old, unknown_element, unsupported, exact, fuzzy, too_short
    (no exact match and nothing to compare fuzzily, for cells), no_match. Footnote
    and text box changes are routed to their own joins (verdict ``deferred``).
    """
    key = ["doc_id", "element_id"]
    base = changes.withColumn("route", route(F.coalesce("element_id", F.lit(""))))
    joined = base.join(elements.select(*key, "text"), key, "left").withColumn("__a", norm(F.col("old"))).withColumn("__b", norm(F.col("text")))
    a, b = F.col("__a"), F.col("__b")
    kind = (
        F.when(F.col("old").isNull(), "missing_old")
        .when(F.col("text").isNull(), "unknown_element")
        .when(F.col("route") == "unsupported", "unsupported")
        .when(F.col("route").isin("footnote", "textbox"), "deferred")
        .when(F.when(F.col("route") == "table_cell", paragraph_with(F.col("text"), F.col("old")).isNotNull()).otherwise(b.contains(a)), "exact")
        .when((F.col("route") == "table_cell") & short_or_numeric(F.col("old")), "too_short")
    )
    # One join for all: rows that are decided, or too far apart in length, reach the Python worker as nulls.
    open_ = F.col("verdict").isNull() & could_be_similar(a, b)
    decided = joined.withColumn("verdict", kind)
    scored = decided.withColumn("score", similarity(F.when(open_, a), F.when(open_, b)))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= THRESHOLD, "fuzzy").otherwise("no_match"))
    score = F.when(open_, F.col("score"))
    return scored.select("doc_id", "change_no", "element_id", "route", verdict.alias("verdict"), score.alias("score"), "text", "old", "new")


def cell_matches(changes: DataFrame, cell_paragraphs: DataFrame) -> DataFrame:
    """Changes of cells (doc_id, change_no, element_id, old) with the paragraph they match.

    The first paragraph that holds the old text; else the whole cell if it is
    similar, applied to paragraph 0; short or numeric old texts are not
    compared fuzzily.
    """
    key = ["doc_id", "element_id"]
    first = changes.join(cell_paragraphs, key).filter(exact(F.col("text"), F.col("old"))).groupBy("doc_id", "change_no").agg(F.min("par_no").cast("long").alias("par_no"))
    whole = cell_paragraphs.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    hits = changes.join(first, ["doc_id", "change_no"]).select("doc_id", "change_no", "element_id", "par_no", F.lit("exact").alias("how"))
    rest = changes.join(first, ["doc_id", "change_no"], "left_anti").filter(~short_or_numeric(F.col("old"))).join(whole, key)
    return hits.union(fuzzy(rest).select("doc_id", "change_no", "element_id", F.lit(0).cast("long").alias("par_no"), F.lit("fuzzy").alias("how")))


def join_footnotes(changes: DataFrame, notes: DataFrame) -> DataFrame:
    """Footnote changes with the note of their id; those without id are rejected elsewhere."""
    return changes.join(notes.select("doc_id", "footnote_id", F.col("text").alias("baseline")), ["doc_id", "footnote_id"])


def join_textboxes(changes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text box changes with the first box of the document that holds the old text.

    The box that a change names does not matter, but ``other_box`` tells when
    it is another one. Candidates are joined per document; only the change's
    key and the box's number take part in finding the first.
    """
    b = boxes.select("doc_id", F.col("element_id").alias("box_id"), F.col("seq").alias("box_no"), F.col("text").alias("box_text"))
    pairs = changes.join(b, "doc_id").filter(norm_box(F.col("box_text")).contains(norm_box(F.col("old"))))
    first = F.min_by(F.struct("box_id", "box_no", "box_text"), "box_no")
    return pairs.groupBy("doc_id", "change_no").agg(F.first("element_id").alias("element_id"), F.first("old").alias("old"), F.first("new").alias("new"), first.alias("b")).select("doc_id", "change_no", "element_id", "old", "new", "b.box_id", "b.box_text", (F.col("element_id") != F.col("b.box_id")).alias("other_box"))


def literal_replacement(text: Column, old: Column, new: Column) -> Column:
    """The first literal occurrence replaced; null where there is none (the UDF decides those)."""
    at = F.instr(text, old)
    done = F.concat(F.substring(text, F.lit(1), at - 1), F.coalesce(new, F.lit("")), F.substring(text, at + F.length(old), F.length(text)))
    return F.when((at > 0) & (old != ""), done)


def replacement(rows: DataFrame) -> DataFrame:
    """Rows (text, old, new, ...) with ``result``: the literal branch in the JVM, the rest by UDF.

    One pass: rows that the JVM decides reach the Python worker as nulls.
    """
    found = rows.withColumn("__literal", literal_replacement(F.col("text"), F.col("old"), F.col("new")))
    open_ = lambda c: F.when(F.col("__literal").isNull(), F.col(c))
    return found.withColumn("result", F.coalesce("__literal", replaced(open_("text"), open_("old"), open_("new")))).drop("__literal")


def comment_eligible(motivation: Column, element_id: Column, wanted: bool = True) -> Column:
    """Whether a change gets a comment: it has a motivation, and Word allows one there."""
    return F.lit(wanted) & (F.coalesce(motivation, F.lit("")) != "") & ~element_id.contains("header") & ~element_id.contains("footer")


def apply_sequential(matched: DataFrame) -> DataFrame:
    """(doc_id, element_id, text, result, n_changes, conflict): all matched changes of an element, one after the other, on clean text.

    ``matched``: doc_id, element_id, change_no, text, old, new. An element's
    changes are gathered in the JVM; the UDF sees a batch of elements at a time.
    """
    listed = F.array_sort(F.collect_list(F.struct("change_no", "old", "new")))
    groups = matched.groupBy("doc_id", "element_id").agg(F.first("text").alias("text"), listed.alias("changes"))
    folded = groups.withColumn("result", replaced_all("text", F.transform("changes", lambda c: F.coalesce(c["old"], F.lit(""))), F.transform("changes", lambda c: F.coalesce(c["new"], F.lit("")))))
    return folded.select("doc_id", "element_id", "text", "result", F.size("changes").cast("long").alias("n_changes"), (F.size("changes") > 1).alias("conflict"))


def unapplied(verdict: DataFrame) -> DataFrame:
    """Changes that no match applied."""
    return verdict.filter(~F.col("verdict").isin("exact", "fuzzy", "deferred")).select("doc_id", "change_no", "element_id", "verdict")


def summary(verdict: DataFrame) -> DataFrame:
    """Counts of verdicts per document."""
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return verdict.groupBy("doc_id").agg(F.count("*").alias("n_changes"), n("exact").alias("n_exact"), n("fuzzy").alias("n_fuzzy"), n("deferred").alias("n_deferred"), n("missing_old", "unknown_element", "unsupported", "too_short", "no_match").alias("n_unapplied"))


def top1(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; ties are broken by ``order`` alone."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
