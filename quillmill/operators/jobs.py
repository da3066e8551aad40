"""Jobs: their latest status, the answer to a poll, what may be deleted, fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffix

#: Kept for (seconds).
RETENTION = {"uploads": 3600, "logs": 30 * 24 * 3600, "results": 3600}


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each job (job_id, seq, status, done, error). Repeats of a sequence number are equal."""
    last = F.max_by(F.struct("seq", "status", "done", "error"), "seq")
    return events.groupBy("job_id").agg(last.alias("e")).select("job_id", "e.*")


def status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, code, state): the answer to a poll, for all jobs and results (job_id) there are."""
    both = jobs.withColumn("known", F.lit(True)).join(results.select("job_id").distinct().withColumn("file", F.lit(True)), "job_id", "full_outer")
    known, file, done = F.coalesce("known", F.lit(False)), F.coalesce("file", F.lit(False)), F.coalesce("done", F.lit(False))
    code = F.when(known & F.col("error").isNotNull(), 500).when(known & ~done, 202).when(known & ~file, 500).when(file, 200).otherwise(202)
    state = F.when(known & F.col("error").isNotNull(), "error").when(known & ~done, "running").when(known & ~file, "result missing").otherwise("done")
    return both.select("job_id", code.cast("long").alias("code"), state.alias("state"))


def expired(files: DataFrame, now: Column, seconds: int, stamp: str = "modificationTime") -> DataFrame:
    """Files older than ``seconds``, strictly. ``now`` is given, so a rerun agrees."""
    return files.filter(now.cast("timestamp").cast("double") - F.col(stamp).cast("timestamp").cast("double") > seconds)


def with_fallback(rows: DataFrame, column: str, primary: Callable[[str], str], fallback: Callable[[str], str]) -> DataFrame:
    """Adds result, used (primary, fallback, none) and error: what fails is a row's own matter."""
    columns = [f.name for f in rows.schema]

    def run(frames):
        for frame in frames:
            out = []
            for value in frame[column]:
                try:
                    out.append((primary(value), "primary", None))
                    continue
                except Exception as e:
                    first = f"{type(e).__name__}: {e}"
                try:
                    out.append((fallback(value), "fallback", first))
                except Exception as e:
                    out.append((None, "none", f"{first}; {type(e).__name__}: {e}"))
            yield frame[columns].assign(result=[o[0] for o in out], used=[o[1] for o in out], error=[o[2] for o in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, result string, used string, error string")


def result_path(job_id: Column, original: Column, folder: str = "results") -> Column:
    """Where a job's result goes: with the suffix of what was uploaded."""
    return F.concat(F.lit(f"{folder}/"), job_id.cast("string"), F.lit(".result"), suffix(original))


def audit(jobs: DataFrame, verdicts: DataFrame, at: Column) -> DataFrame:
    """(job_id, doc_id, at, verdict, n): what a session did, to be written with its results."""
    counts = verdicts.groupBy("doc_id", "verdict").agg(F.count("*").alias("n"))
    return jobs.select("job_id", "doc_id").join(counts, "doc_id").select("job_id", "doc_id", at.alias("at"), "verdict", "n")
