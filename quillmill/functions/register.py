"""The library's functions for SQL text: scalar functions and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .udfs import ndiff_words, replaced, similarity, word_diff


class DiffWords:
    """``diff_words(old, new)``: one row per segment of a word diff."""

    def eval(self, old: str, new: str):
        yield from ndiff_words(old, new)


def register(spark: SparkSession) -> None:
    """Register similarity, word_diff, replace_text and the table function diff_words in the session."""
    spark.udf.register("similarity", similarity)
    spark.udf.register("word_diff", word_diff)
    spark.udf.register("replace_text", replaced)
    spark.udtf.register("diff_words", udtf(DiffWords, returnType="ord int, kind string, val string", useArrow=True))
