"""Office packages as a data source: ``spark.read.format("office_parts").load(folder)``.

One row per part, one partition per PACKAGES_PER_TASK files. Files are listed
and read through Arrow's file systems, so a folder may be a URI; a path without
a scheme is a local one. Options: ``suffix`` (.docx), and ``limit``, the bytes
that a package may unpack to (MAX_BYTES); one beyond is a row with an error.
For stores that only Spark reads, use ``scan_packages`` and ``scan_parts``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .parts import MAX_BYTES, unpack

PACKAGES_PER_TASK = 64


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


class PartsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".docx").lower()
        self.limit = int(options.get("limit", MAX_BYTES))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = _open(self.folder)
        found = sorted(i.path for i in store.get_file_info(fs.FileSelector(base)) if i.is_file and i.path.lower().endswith(self.suffix))
        return [Files(found[k : k + PACKAGES_PER_TASK]) for k in range(0, len(found), PACKAGES_PER_TASK)] or [Files([])]

    def read(self, partition: Files):
        store, _ = _open(self.folder)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                yield from unpack(path, f.read(), self.limit)


class PartsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office_parts"

    def schema(self) -> str:
        return "path string, part_name string, content binary, error string"

    def reader(self, schema) -> PartsReader:
        return PartsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PartsSource)
