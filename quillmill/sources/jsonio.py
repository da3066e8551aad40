"""Structures and changes as JSON files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schemas import CHANGES, DOCX_STRUCTURE, PDF_STRUCTURE


def read_structure(spark: SparkSession, path: str, kind: str = "docx", multi_line: bool = True) -> DataFrame:
    """Structures: one indented document a file, or one a line. An empty or foreign file gives a row with null type, which the caller rejects."""
    return spark.read.schema(DOCX_STRUCTURE if kind == "docx" else PDF_STRUCTURE).option("multiLine", multi_line).json(path)


def elements_of(structures: DataFrame) -> DataFrame:
    """(doc_id, pos, element fields) of docx structures."""
    return structures.select("doc_id", F.posexplode("elements").alias("pos", "e")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "e.*")


def read_changes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Changes (a record a line), and the lines that don't fit the schema."""
    raw = spark.read.text(path).filter(~is_blank(F.col("value")))
    schema = f"{CHANGES}, _corrupt_record string"
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_corrupt_record"), parsed.filter(bad).select(F.col("value").alias("raw"))


def write_structure(elements: DataFrame, path: str) -> None:
    """One JSON record per document, elements in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("type", "element_id", "footnote_id", "text", "empty").alias("e")))), lambda x: x["e"])
    elements.groupBy("doc_id").agg(F.lit("docx").alias("type"), items.alias("elements")).write.mode("overwrite").json(path)


def write_changes(changes: DataFrame, path: str) -> None:
    changes.write.mode("overwrite").json(path)
