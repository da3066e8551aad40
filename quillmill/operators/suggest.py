"""Where suggestions come from, and what becomes of replies.

A suggester answers batches. The ones here need no network: one looks replies
up, one applies a lexicon with built-in functions. A remote model plugs in as a
function from messages to text; it runs once per batch inside a task, errors
are kept per batch and do not stop the others.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_fences, split_words, strip
from ..schemas import REPLY_ITEMS


class Suggester(Protocol):
    def replies(self, batches: DataFrame) -> DataFrame:
        """(doc_id, chunk_id, ok, raw) for (doc_id, chunk_id, messages)."""


class TableSuggester:
    """Replies from a table (doc_id, chunk_id, raw); a batch without one has failed."""

    def __init__(self, table: DataFrame):
        self.table = table

    def replies(self, batches: DataFrame) -> DataFrame:
        return batches.select("doc_id", "chunk_id").join(self.table, ["doc_id", "chunk_id"], "left").select("doc_id", "chunk_id", F.col("raw").isNotNull().alias("ok"), "raw")


class FunctionSuggester:
    """Calls ``ask(messages) -> text`` per batch, over all tasks at most one in ``pause`` seconds.

    Tasks take turns: each of ``tasks`` begins at its own place in a round of
    that many pauses and calls once a round, so they need not know of each other.
    """

    def __init__(self, ask: Callable[[list[dict]], str], tasks: int = 8, pause: float = 0.0):
        self.ask, self.tasks, self.pause = ask, tasks, pause

    def replies(self, batches: DataFrame) -> DataFrame:
        ask, pause, tasks = self.ask, self.pause, self.tasks

        def run(frames):
            import pandas as pd

            turn = TaskContext.get().partitionId() % tasks if TaskContext.get() else 0
            due = time.time() + turn * pause
            for frame in frames:
                rows = []
                for doc_id, chunk_id, messages in zip(frame["doc_id"], frame["chunk_id"], frame["messages"]):
                    time.sleep(max(0.0, due - time.time()))
                    due = max(due, time.time()) + tasks * pause
                    try:
                        rows.append((doc_id, chunk_id, True, ask([dict(m) for m in messages])))
                    except Exception as e:  # one batch's failure is a fact about that batch
                        rows.append((doc_id, chunk_id, False, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "ok", "raw"])

        return batches.repartition(self.tasks, "doc_id", "chunk_id").mapInPandas(run, "doc_id bigint, chunk_id bigint, ok boolean, raw string")


def first_match(text: Column, lexicon: dict[str, str]) -> tuple[Column, Column]:
    """The first word of a text that is in the lexicon, and its replacement; nulls without one."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    word = F.get(F.filter(split_words(text), lambda w: w.isin(*lexicon)), F.lit(0))
    return word, F.try_element_at(table, word)


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (doc_id, chunk_id, pos, change fields) of replies that are JSON arrays of objects, and rejects with a reason.

    Rejected: failed calls, text that is no JSON array (a bare object
    included), items whose page or line is no integer.
    """
    cleaned = replies.withColumn("cleaned", strip(clean_fences(F.coalesce("raw", F.lit("")))))
    parsed = cleaned.withColumn("items", F.when(F.col("ok") & F.col("cleaned").startswith("["), F.from_json("cleaned", REPLY_ITEMS)))
    reason = F.when(~F.col("ok"), "failed").when(~F.col("cleaned").startswith("["), "not an array").when(F.col("items").isNull(), "not JSON")
    bad = parsed.filter(F.col("items").isNull()).select("doc_id", "chunk_id", F.lit(None).cast("bigint").alias("pos"), reason.alias("reason"), "raw")
    rows = parsed.filter(F.col("items").isNotNull()).select("doc_id", "chunk_id", "raw", F.posexplode("items").alias("pos", "item")).select("doc_id", "chunk_id", "raw", F.col("pos").cast("long").alias("pos"), "item.*")
    number = lambda c: F.col(c).isNull() | F.col(c).try_cast("int").isNotNull()
    good = number("page") & number("line")
    items = rows.filter(good).drop("raw").withColumns({c: F.col(c).cast("int") for c in ("page", "line")})
    return items, bad.unionByName(rows.filter(~good).select("doc_id", "chunk_id", "pos", F.lit("page or line is no integer").alias("reason"), "raw"))


def batch_outcomes(replies: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, outcome, n_items) per batch: an array's items, or why there is none."""
    items = F.when(F.col("ok") & F.col("c").startswith("["), F.from_json("c", REPLY_ITEMS))
    outcome = F.when(~F.col("ok"), "failed").when(~F.col("c").startswith("["), "not an array").when(F.col("items").isNull(), "not JSON").otherwise("ok")
    return replies.withColumn("c", strip(clean_fences(F.coalesce("raw", F.lit(""))))).withColumn("items", items).select("doc_id", "chunk_id", outcome.alias("outcome"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"))


def effective_temperature(model: Column, given: Column) -> Column:
    """Models that accept one value only get it; others the given one, or 0.7."""
    return F.when(model.startswith("gpt-5"), F.lit(1.0)).otherwise(F.coalesce(given.cast("double"), F.lit(0.7)))
