"""Batches of elements under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_length

#: Budget in "tokens" of four characters.
MAX_TOKENS, CHARS_PER_TOKEN = 3000, 4


def element_length(pdf: bool = False) -> Column:
    """Characters of an element as the model is shown it."""
    names = ("page", "line", "text") if pdf else ("type", "element_id", "text", "empty", "footnote_id")
    return json_length({n: F.col(n) for n in names})


def chunk_greedy(elements: DataFrame, size: Column, prompt_chars: int, max_tokens: int = MAX_TOKENS, order: str = "pos", empty_first: bool = False) -> DataFrame:
    """(doc_id, pos, chunk_id): a batch is closed when the next element would exceed the budget.

    Whether a batch is closed depends on what is in it, so this is a fold over
    a document's (position, size) pairs, without its texts, and no window sum.
    ``empty_first``: an oversize first element leaves an empty batch before it
    (ids then start at 1), as in the model; otherwise no batch is empty.
    """
    listed = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("pos"), size.cast("long").alias("n")))).alias("items"))
    folded = listed.withColumn("bounds", _bounds("items", prompt_chars, max_tokens, empty_first))
    batch = lambda k: F.transform(_batch(k), lambda x: F.struct(x["pos"].alias("pos"), k.cast("long").alias("chunk_id")))
    return folded.select("doc_id", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), batch))))


def _bounds(items: str, prompt_chars: int, max_tokens: int, empty_first: bool = False) -> Column:
    """Places of the batches' first elements among a document's ordered items (with their size ``n``), and their number."""
    budget = max_tokens * CHARS_PER_TOKEN
    start = F.struct(F.lit(prompt_chars).cast("long").alias("used"), F.lit(empty_first).alias("open"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(acc, x):
        full = acc["open"] & (acc["used"] + x["n"] > budget)
        used = F.when(full, F.lit(prompt_chars)).otherwise(acc["used"]) + x["n"]
        # only the place of a new batch's first element is kept, so the state grows with the batches
        begins = F.when(full, F.concat(acc["begins"], F.array(acc["at"]))).otherwise(acc["begins"])
        return F.struct(used.cast("long").alias("used"), F.lit(True).alias("open"), (acc["at"] + 1).alias("at"), begins.alias("begins"))

    return F.aggregate(items, start, step, lambda acc: F.concat(F.array(F.lit(0)), acc["begins"], F.array(acc["at"])))


def _batch(k: Column) -> Column:
    """A batch is a slice of the items, so each of them is touched once, whatever the number of batches."""
    return F.slice("items", F.get("bounds", k) + 1, F.get("bounds", k + 1) - F.get("bounds", k))


def chunk_greedy_grouped(elements: DataFrame, size: Column, prompt_chars: int, max_tokens: int = MAX_TOKENS, order: str = "pos") -> DataFrame:
    """The same for documents of very many elements: linear in their number, one document in a task."""
    budget = max_tokens * CHARS_PER_TOKEN

    def run(group):
        group = group.sort_values("pos")
        used, chunk, out = prompt_chars, 0, []
        for k, n in enumerate(group["n"]):
            if k and used + n > budget:
                chunk, used = chunk + 1, prompt_chars
            used += n
            out.append(chunk)
        return group[["doc_id", "pos"]].assign(chunk_id=out)

    rows = elements.select("doc_id", F.col(order).cast("long").alias("pos"), size.cast("long").alias("n"))
    return rows.groupBy("doc_id").applyInPandas(run, "doc_id bigint, pos bigint, chunk_id bigint")


def batch_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n_batches"))


def messages(elements: DataFrame, chunks: DataFrame, prompt: str, preamble: str) -> DataFrame:
    """(doc_id, chunk_id, messages): what a model is asked per batch."""
    joined = elements.join(chunks, ["doc_id", "pos"])
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", _shown().alias("j")))), lambda x: x["j"])
    return joined.groupBy("doc_id", "chunk_id").agg(_asked(body, prompt, preamble).alias("messages"))


def greedy_messages(elements: DataFrame, size: Column, prompt: str, preamble: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The same for the batches of `chunk_greedy`, with the elements gathered once, by document, and no join."""
    listed = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), size.cast("long").alias("n"), _shown().alias("j")))).alias("items"))
    folded = listed.withColumn("bounds", _bounds("items", len(prompt), max_tokens))
    numbered = folded.select("doc_id", "items", "bounds", F.explode(F.sequence(F.lit(0), F.size("bounds") - 2)).alias("k"))
    return numbered.select("doc_id", F.col("k").cast("long").alias("chunk_id"), _asked(F.transform(_batch(F.col("k")), lambda x: x["j"]), prompt, preamble).alias("messages"))


def _shown() -> Column:
    return F.to_json(F.struct("type", "element_id", "footnote_id", "text", "empty"))


def _asked(items: Column, prompt: str, preamble: str) -> Column:
    user = F.concat(F.lit(preamble + " ["), F.array_join(items, ", "), F.lit("]"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(prompt)), message("user", user))


def concat_batches(items: DataFrame) -> DataFrame:
    """Suggestions (doc_id, chunk_id, pos, ...) with ``change_no``: their place over all batches of a document."""
    return items.withColumn("change_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "pos")).cast("long"))
