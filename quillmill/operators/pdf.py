"""Changes against the lines of pages, and the notes that they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_pdf, norm, strip
from ..sources.elements import numbered_lines

#: Lines to either side that are tried, distance below which notes are the same.
NEAR, DISTANCE = 2, 5.0
SUGGESTION, MOTIVATION = "Förslag", "Motivering"
#: Fixed value: the type of highlights among annotations.
HIGHLIGHT = 8


def valid(changes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Changes with an old text and a page that the document (doc_id, n_pages) has."""
    return changes.filter("page IS NOT NULL AND old IS NOT NULL AND page >= 1").join(page_counts, "doc_id").filter("page <= n_pages").drop("n_pages")


def holds(text: Column, old: Column) -> Column:
    """Whether the cleaned line holds the old text, or the old text the cleaned line."""
    return norm(clean_pdf(text)).contains(norm(old)) | norm(clean_pdf(old)).contains(norm(clean_pdf(text)))


def exact_line(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """Changes that the named line holds."""
    joined = changes.filter("line IS NOT NULL AND line <> 0").join(lines, ["doc_id", "page", "line"])
    return joined.filter(holds(F.col("text"), F.col("old")))


def line_matches(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, change_no, page, target, line, how) of changes that name a line.

    The named line if it holds the change (``exact``), else the first line
    within NEAR that does (``near``). The band is five keys per change, so one
    equi-join finds both, and an aggregation with partial results picks.
    """
    band = changes.filter("line IS NOT NULL AND line <> 0").withColumn("target", F.col("line")).withColumn("line", F.explode(F.sequence(F.col("line") - NEAR, F.col("line") + NEAR)))
    hits = band.join(lines, ["doc_id", "page", "line"]).filter(holds(F.col("text"), F.col("old")))
    best = F.min(F.struct((F.col("line") != F.col("target")).alias("off"), "line", "target", "page"))
    return hits.groupBy("doc_id", "change_no").agg(best.alias("b")).select("doc_id", "change_no", "b.page", "b.target", "b.line", F.when(F.col("b.off"), "near").otherwise("exact").alias("how"))


def near_line(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """Changes that the named line does not hold, with the first line within NEAR that does."""
    return line_matches(changes, lines).filter("how = 'near'")


def on_page(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """Changes without a line, with the lines of their page that hold the old text in any case."""
    joined = changes.filter("line IS NULL OR line = 0").drop("line").join(lines, ["doc_id", "page"])
    return joined.filter((F.col("old") != "") & F.lower("text").contains(F.lower("old")))


def matches(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, change_no, page, line, how) of every match."""
    pages = on_page(changes, lines).select("doc_id", "change_no", "page", "line", F.lit("page").alias("how"))
    return line_matches(changes, lines).drop("target").unionByName(pages)


def note(new: Column, motivation: Column, motivations: bool = True) -> Column:
    """Text of a note; null if there is nothing to suggest."""
    text = F.concat(F.lit(f"{SUGGESTION}: "), new)
    if motivations:
        text = F.concat(text, F.lit(f" \n\n{MOTIVATION}: "), F.coalesce(motivation, F.lit("")))
    return F.when(F.coalesce(new, F.lit("")) != "", text)


def dedupe_notes(annotations: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """The notes of each page that stay: in order, one is dropped if a kept one has its text, or all four coordinates closer than ``distance``.

    The outcome depends on the order and is not transitive, so it is a fold
    over a page's notes, in the JVM. Its state is the notes kept so far. With a
    column ``kind``, only highlights are compared; annotations of other types all stay.
    """
    if "kind" in annotations.columns:
        highlights = F.coalesce(F.col("kind") == HIGHLIGHT, F.lit(False))
        kept = dedupe_notes(annotations.filter(highlights).withColumnRenamed("kind", "__kind"), distance).withColumnRenamed("__kind", "kind")
        return kept.select(*annotations.columns).union(annotations.filter(~highlights))
    columns = annotations.columns
    text = lambda x: strip(F.coalesce(x["content"], F.lit("")))

    def same(k, x):
        close = F.lit(True)
        for c in ("x0", "y0", "x1", "y1"):
            close = close & (F.abs(k[c] - x[c]) < distance)
        return (text(k) == text(x)) | close

    items = F.array_sort(F.collect_list(F.struct("ord", *[c for c in columns if c not in ("doc_id", "page", "ord")])))
    pages = annotations.groupBy("doc_id", "page").agg(items.alias("items"))
    none = F.slice("items", 1, 0)
    kept = F.aggregate("items", none, lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return pages.select("doc_id", "page", F.inline(kept)).select(*columns)


def annotate(changes: DataFrame, blocks: DataFrame, motivations: bool = True) -> tuple[DataFrame, DataFrame]:
    """Changes of pages as notes, without duplicates, and rejects: every change has notes or a reject.

    changes (doc_id, change_no, page, line, old, new, motivation), blocks (doc_id, page, ord, x0, y0, x1, y1, text).
    Notes (doc_id, page, ord, x0, y0, x1, y1, content, change_no) lie on the lines that match, in the order of
    changes, then lines; a change that suggests nothing has a note without content. Rejects (doc_id, change_no,
    reason): ``invalid`` without an old text or a page that is there, ``no match``, ``duplicate`` if all its notes repeat others.
    """
    counts = blocks.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    lines = numbered_lines(blocks)
    good = valid(changes, counts)
    found = matches(good, lines.select("doc_id", "page", "line", "text"))
    placed = found.select("doc_id", "change_no", "page", "line").join(good.select("doc_id", "change_no", note(F.col("new"), F.col("motivation"), motivations).alias("content")), ["doc_id", "change_no"]).join(lines.drop("text"), ["doc_id", "page", "line"])
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("change_no", "line"))
    every = placed.select("doc_id", "page", order.alias("ord"), "x0", "y0", "x1", "y1", "content", "change_no")
    kept = dedupe_notes(every)
    key = ["doc_id", "change_no"]
    state = changes.select(*key).join(good.select(*key, F.lit(True).alias("good")).distinct(), key, "left").join(found.select(*key, F.lit(True).alias("found")).distinct(), key, "left").join(kept.select(*key, F.lit(True).alias("kept")).distinct(), key, "left")
    reason = F.when(F.col("good").isNull(), "invalid").when(F.col("found").isNull(), "no match").when(F.col("kept").isNull(), "duplicate")
    return kept, state.withColumn("reason", reason).filter("reason IS NOT NULL").select(*key, "reason")
