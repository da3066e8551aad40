"""Reviewing documents as they arrive (an extension): each micro-batch is a batch review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.batching import MAX_TOKENS
from ..plans.review import review
from ..sources.elements import from_documents


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def review_stream(docs: DataFrame, suggester, prompt: str, out: str, checkpoint: str, max_tokens: int = MAX_TOKENS) -> StreamingQuery:
    """Segments and verdicts of each micro-batch in folders of their own; a batch that is repeated after a failure overwrites its folders."""

    def put(batch: DataFrame, number: int) -> None:
        done = review(from_documents(batch), suggester, prompt, max_tokens)
        for name, df in (("segments", done.segments), ("verdicts", done.verdicts), ("rejects", done.rejects)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
