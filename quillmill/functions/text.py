"""String functions as columns. Whitespace is Python's, which is wider than Java's ``\\s`` or ``trim``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One whitespace character in the sense of Python's str.strip, as Java regular expression.
PYWS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{PYWS}+", ""), f"{PYWS}+$", "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]")


def norm(c: Column) -> Column:
    """Runs of whitespace become one blank; none at the ends."""
    return strip(F.regexp_replace(c, f"{PYWS}+", " "))


def norm_box(c: Column) -> Column:
    """No whitespace at all; en and em dashes as hyphens; null as empty."""
    return F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), f"{PYWS}+", ""), "–—", "--")


def clean_pdf(c: Column) -> Column:
    """Without the one to three digits that end a word (footnote marks run into it), stripped."""
    return strip(F.regexp_replace(c, r"(?<=[a-zA-Z])\p{Nd}{1,3}(?![\p{L}\p{N}_])", ""))


def split_words(c: Column) -> Column:
    """Array of words; empty for blank text."""
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(F.split(norm(c), " "))


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def json_length(fields: dict[str, Column]) -> Column:
    """Length of a record as JSON with ``", "`` and ``": "`` separators; null fields are left out."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in fields.values()), F.lit(0))
    plain = F.length(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])))
    return (plain + F.greatest(2 * n - 1, F.lit(0))).cast("long")


def clean_fences(c: Column) -> Column:
    """Text between code fences, stripped; text that doesn't begin with a fence stays as it is."""
    s = strip(c)
    inner = F.regexp_replace(strip(F.regexp_replace(s, r"^```(?:json)?", "")), r"```$", "")
    return F.when(s.startswith("```"), strip(inner)).otherwise(c)


def output_name(c: Column, tag: str = "klarspråkad") -> Column:
    """``base_tag.ext``; without an extension the tag is appended."""
    dot = c.rlike(r"\.[^.]*$")
    return F.when(dot, F.regexp_replace(c, r"\.([^.]*)$", f"_{tag}.$1")).otherwise(F.concat(c, F.lit(f"_{tag}")))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
