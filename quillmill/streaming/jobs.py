"""The job tables as streams: the same transformations over a file source.

An extension: the batch functions stay the definition, and tests hold the
streams against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import expired, latest_status
from ..schemas import JOB_EVENTS


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(JOB_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def status_stream(events: DataFrame) -> DataFrame:
    """Latest status per job; the state is one row per job. Write it in update mode."""
    return latest_status(events)


def write_status(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed jobs go to their own folder, so a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return status_stream(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The latest status over all batches."""
    return latest_status(spark.read.parquet(path))


def expired_stream(files: DataFrame, now, seconds: int, stamp: str = "ts") -> DataFrame:
    """Old files as they appear: stateless, so it is the batch filter."""
    return expired(files, now, seconds, stamp)


def events_per_window(events: DataFrame, stamp: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type with a watermark (extension)."""
    ts = F.col(stamp).cast("timestamp")
    return events.withColumn("__ts", ts).withWatermark("__ts", late).groupBy(F.window("__ts", window), "event_type").agg(F.count("*").alias("n"))
