"""Session builder with the settings that every plan here assumes, and the folder that a cluster shares."""

from __future__ import annotations

import atexit
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, app: str = "quillmill") -> SparkSession:
    """A session in UTC with adaptive execution; other settings come from the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named by ``spark.checkpoint.dir``. Where that is unset, a
    local session gets a temporary folder; a cluster gets a folder in the
    warehouse, which is shared by definition.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="quillmill-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillmill"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: The paths that the innermost `scratch` hands out.
_paths: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("quillmill-paths", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet. Within `scratch` it lives as long as that."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    held = _paths.get()
    if held is not None:
        held.append(path)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Empty tables or folders that nothing reads any more. Spark overwrites them, so this works on any file system that it knows."""
    for path in paths:
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Empty, at the end, what was staged within: ``with scratch(spark): query(spark).write.parquet(...)``.

    Queries are lazy, so their results must be written, or collected, inside.
    """
    held: list[str] = []
    token = _paths.set(held)
    try:
        yield
    finally:
        _paths.reset(token)
        release(spark, *held)
