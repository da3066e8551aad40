"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (its words). The mix has
``share`` times all words. A source's target is its weight's share, but never
above ``max_epochs`` times its size; what is cut off is shared out again by
weight until no target is above its cap: the water level L with
target = min(cap, L * weight) rises by rounds, each one aggregation over the
table of sources, of which two numbers reach the driver. No task sees all sources,
so there may be one for every domain.

A target is then met by whole repetitions of a source plus a seeded part of
it: the documents of a source stand in the order of a seeded hash and are
taken from the front until the words suffice. The running sum is not taken
over a whole source (one source may hold most rows) but over (source, first
hash digits) and put together from the sums of these pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_rows, n_words, staged

#: The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MAX_EPOCHS = 1.5, 2
#: Leading hex digits of the order hash that cut a source into pieces.
PIECE_DIGITS = 3


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` double to one row per source (``weight``, ``source_size``).

    A round sets the level from the sources that are not clamped at their cap,
    which clamps some more; it ends when it clamps no other. Sources with equal
    weights are clamped in the order of their sizes, so rounds are few.
    """
    cap = (F.col("source_size") * max_epochs).cast("double")
    ratio = cap / F.col("weight")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = None, -1
    while True:
        free = F.lit(True) if level is None else ratio >= level
        got = sources.agg(F.count(F.when(~free, 1)).alias("n"), F.sum(F.when(~free, cap)).alias("before"), F.sum(F.when(free, F.col("weight"))).alias("rest")).first()
        if got["n"] == clamped:
            break
        clamped = got["n"]
        if not got["rest"]:
            level = None
            break
        level = (total - (got["before"] or 0.0)) / got["rest"]
    return sources.withColumn("target", cap if level is None else F.least(cap, F.lit(level) * F.col("weight")))


def numbered(sources: DataFrame, key: str) -> DataFrame:
    """Adds ``__qm_pos``, the place by ``key`` (unique) from 0 on: sorted by ranges, numbered within each, and shifted by the ranges' counts."""
    placed = sources.orderBy(key).select("*", F.spark_partition_id().alias("__qm_range"), F.monotonically_increasing_id().alias("__qm_at"))
    placed = staged(placed, "mix-sources")
    counts = {r["__qm_range"]: (r["n"], r["low"]) for r in placed.groupBy("__qm_range").agg(F.count("*").alias("n"), F.min("__qm_at").alias("low")).collect()}
    rows, before = [], 0
    for part in sorted(counts):
        rows.append({"__qm_range": part, "__qm_shift": before - counts[part][1]})
        before += counts[part][0]
    shifts = local_rows(sources.sparkSession, rows, "__qm_range int, __qm_shift long")
    return placed.join(F.broadcast(shifts), "__qm_range").withColumn("__qm_pos", F.col("__qm_at") + F.col("__qm_shift")).drop("__qm_range", "__qm_at", "__qm_shift")


def source_key(source: Column) -> Column:
    """Sorts as the source by code point, nulls last, and can be joined on."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def plan_mix(sized: DataFrame, seed: int = 17, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sized`` has doc_id, source, size. Adds source_size, target, whole, part, taken.

    ``whole`` repetitions of every document, and ``part`` more words of it: all
    of it, none, or, for the one document of a source at which the target is
    reached, some. ``taken`` = whole * size + part. Null sources form a source
    of their own, null ids hash as an empty string, documents of size 0 take 0.
    """
    order = F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = sized.withColumn("__qm_src", source_key(F.col("source"))).withColumn("__qm_order", order).withColumn("__qm_piece", F.substring("__qm_order", 1, PIECE_DIGITS))
    pieces = rows.groupBy("__qm_src", "__qm_piece").agg(F.sum("size").alias("__qm_sum"))
    by_source = pieces.groupBy("__qm_src").agg(F.sum("__qm_sum").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__qm_pos") % len(weights) + 1).cast("int"))
    targets = water_fill(numbered(by_source, "__qm_src").withColumn("weight", weight), share, max_epochs)
    starts = pieces.withColumn("__qm_from", F.sum("__qm_sum").over(Window.partitionBy("__qm_src").orderBy("__qm_piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__qm_sum"))
    info = starts.join(targets, "__qm_src").select("__qm_src", "__qm_piece", "__qm_from", "source_size", "target")
    w = Window.partitionBy("__qm_src", "__qm_piece").orderBy("__qm_order", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("__qm_at", F.sum("size").over(w) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        running.join(info, ["__qm_src", "__qm_piece"])
        .withColumn("whole", whole)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - F.col("whole") * F.col("source_size") - F.col("__qm_from") - F.col("__qm_at"))).cast("long"))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
        .drop("__qm_src", "__qm_piece", "__qm_order", "__qm_from", "__qm_at")
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words; 0 for a null text) of every document, staged: the text is read once."""
    return staged(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "source", n_words(docs["text"]).alias("size")), "mix-sizes")


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Sizes, targets and taken words per document."""
    return plan_mix(sized_documents(docs), seed).select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "part")


def repeat_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    The partly taken document of a source counts as taken if at least half of
    it is. Documents without words are taken once, as they have no share. Rows with equal ids (and sizes) share the copies that
    their ids were given; ids are assumed to name documents.
    """
    copies = plan_mix(sized_documents(docs), seed).select(F.col("doc_id").alias("__qm_id"), F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)).cast("int").alias("__qm_copies"))
    copies = copies.groupBy("__qm_id").agg(F.max("__qm_copies").alias("__qm_copies")).filter("__qm_copies > 0")
    out = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(F.col("__qm_id")))
    return out.withColumn("__qm_n", F.explode(F.sequence(F.lit(1), F.col("__qm_copies")))).select(*[docs[c] for c in docs.columns])
