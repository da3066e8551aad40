"""From raw documents to shards: quality rules, near duplicates, benchmark passages, mixing, sharding.

Each stage reads what its predecessor wrote as Parquet in the shared folder;
what it staged on the way is emptied when it is done, and so is the
predecessor's table. All but the last return the columns of ``documents``; the
last adds shard and slot.

Every stage takes an empty table (none out), columns that it does not know,
whatever their names, and texts of any length. Null and empty texts are texts
without words. Rows that repeat a doc_id, or have none, keep rows of their own
but where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontam, mixing, ngram_join, quality_rules, sharding
from quillmill.session import fresh_path, release, scratch

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    Texts of under 50 words go, so null and empty ones do. Rows are judged one by
    one, so repeated rows stay or go together. Ties in learning go to the rule that sorts first.
    """
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by 5-word shingles and similarity 0.8.

    Rows without id or words are in no group and stay. Rows that repeat the kept
    id stay, unless one of them is linked to a smaller id.
    """
    return ngram_join.keep_one(docs, ngram_join.Spec(words=5, num=80, den=100))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs.

    Each row is judged by its own text. Null texts stay; null items hold no
    window, and an empty benchmark removes nothing.
    """
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for.

    A null source is a source. Documents without words stay once. Rows that
    repeat an id get the copies of the one that is taken most often; ties in the
    seeded order go by size, then id.
    """
    return mixing.repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row.

    Rows that repeat an id, or have none, are spread by the hash of their text;
    rows that are equal in both are interchangeable.
    """
    return sharding.assign(docs, "doc_id", SHARDS, [F.xxhash64("text")])


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark passages", benchmark_passages), ("mix", mix), ("shard", shard)]

#: Learned rules and the similarity join are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    path = fresh_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        if k:
            release(spark, f"{path}/{k - 1}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
