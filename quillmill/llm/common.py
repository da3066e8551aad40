"""What the operators share: staged tables, batches of texts, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: Fixed value: the ASCII whitespace of the word definition, as Spark string.
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: the same as a Java regular expression.
SPACES_RE = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that carries texts, and the setting's name.
BATCH_BYTES, BATCH_SETTING = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own bound, as its setting shows it.
DEFAULT_BYTES = str(64 << 20)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python in batches of BATCH_BYTES at most.

    A batch exists several times at once (JVM, pipe, Python, result), and one
    task's batches must not depend on how long texts are. A session that sets
    a bound of its own keeps it; Spark versions without the setting go by rows.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, DEFAULT_BYTES) in (DEFAULT_BYTES, DEFAULT_BYTES + "b"):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends there, and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; one empty string if there is none."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), SPACES_RE)


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES_RE))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is a
    value, while a column that is named several times may be inlined and
    recomputed at each mention."""
    return F.transform(F.array(value), body)[0]


def local_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small driver-side table as a constant of the plan (no RDD)."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))
