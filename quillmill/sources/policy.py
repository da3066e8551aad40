"""Prompt policy: one text with a locked and an editable section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: The section markers.
START_EDITABLE, END_EDITABLE = "<!-- START_EDITABLE -->", "<!-- END_EDITABLE -->"
START_LOCKED, END_LOCKED = "<!-- START_LOCKED -->", "<!-- END_LOCKED -->"
MARKERS = (START_LOCKED, END_LOCKED, START_EDITABLE, END_EDITABLE)


def _unmarked(c: Column) -> Column:
    for marker in MARKERS:
        c = strip(F.replace(c, F.lit(marker)))
    return c


def sections(policies: DataFrame, text: str = "text") -> DataFrame:
    """Adds editable, locked_before, locked_after and valid (both editable markers are there)."""
    t = F.col(text)
    start, end = F.instr(t, START_EDITABLE), F.instr(t, END_EDITABLE)
    after_start = start + len(START_EDITABLE)
    valid = (start > 0) & (end > 0)
    part = lambda c: F.when(valid, c)
    return (
        policies.withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("editable", part(strip(F.substring(t, after_start, F.greatest(end - after_start, F.lit(0))))))
        .withColumn("locked_before", part(_unmarked(F.substring(t, F.lit(1), start - 1))))
        .withColumn("locked_after", part(_unmarked(F.substring(t, end + len(END_EDITABLE), F.length(t)))))
    )


def forbidden(prompt: Column) -> Column:
    """Whether an edited prompt holds a marker."""
    return F.exists(F.array(*[F.lit(m) for m in MARKERS]), lambda m: prompt.contains(m))


def assemble(before: Column, editable: Column, after: Column) -> Column:
    return F.concat_ws("\n\n", before, editable, after)


def editable_prompt(policies: DataFrame, text: str = "text") -> DataFrame:
    return sections(policies, text).select("valid", F.col("editable").alias("editable_prompt"))
