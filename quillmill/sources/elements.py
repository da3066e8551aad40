"""Scans: documents as flat tables of addressed text elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip, suffix

#: Order of element kinds in a document.
KINDS = ("paragraph", "table_cell", "header", "footer", "textbox", "footnote")
#: Footnote ids that are separators, not notes.
SEPARATORS = ("-1", "0")


def dispatch(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with ``format`` docx or pdf, by suffix; the rest with a reason."""
    ext = suffix(F.col(path))
    known = files.withColumn("ext", ext).withColumn("format", F.when(ext.isin(".docx", ".pdf"), F.substring(ext, 2, 9)))
    return known.filter("format IS NOT NULL").drop("ext"), known.filter("format IS NULL").select(*files.columns, F.concat(F.lit("unsupported: "), F.col("ext")).alias("reason"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, 1-based pos, raw: the text's lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def _element(kind: str, element_id: Column, text: Column, seq: Column, footnote_id: Column | None = None) -> list[Column]:
    clean = strip(text)
    return [F.col("doc_id"), seq.cast("long").alias("seq"), F.lit(kind).alias("type"), element_id.alias("element_id"), (F.lit(None).cast("string") if footnote_id is None else footnote_id).alias("footnote_id"), clean.alias("text"), (clean == "").alias("empty")]


def paragraphs(rows: DataFrame) -> DataFrame:
    """Elements of (doc_id, pos, raw): blank ones stay and are flagged."""
    return rows.select(*_element("paragraph", F.concat(F.lit("paragraph_"), "pos"), F.col("raw"), F.col("pos")))


def table_cells(rows: DataFrame, delimiter: str = " | ") -> DataFrame:
    """Cells of the lines that hold the delimiter; such a document has one table."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    tab = rows.filter(F.col("raw").contains(delimiter)).withColumn("r", F.row_number().over(w))
    cells = tab.select("doc_id", "r", F.posexplode(F.split("raw", delimiter.replace("|", r"\|"))).alias("c", "cell"))
    return cells.select(*_element("table_cell", F.concat_ws("_", F.lit("table_1_cell"), "r", F.col("c") + 1), F.col("cell"), F.col("r") * 10_000 + F.col("c")))


def numbered(rows: DataFrame, kind: str, order: str = "pos", text: str = "raw") -> DataFrame:
    """Elements ``kind_N``, numbered in order within their document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    return rows.withColumn("n", n).select(*_element(kind, F.concat(F.lit(f"{kind}_"), "n"), F.col(text), F.col("n")))


def header_footer(sections: DataFrame) -> DataFrame:
    """Elements of the first section's parts: (doc_id, section, kind header|footer, pos, raw)."""
    first = sections.filter("section = 0")
    n = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos"))
    rows = first.withColumn("n", n)
    clean = strip(F.col("raw"))
    return rows.select("doc_id", F.col("n").cast("long").alias("seq"), F.col("kind").alias("type"), F.concat_ws("_", "kind", "n").alias("element_id"), F.lit(None).cast("string").alias("footnote_id"), clean.alias("text"), (clean == "").alias("empty"))


def footnotes(notes: DataFrame) -> DataFrame:
    """Elements of (doc_id, note_id, pos, raw): separators and blank notes are dropped, then the rest numbered."""
    kept = notes.filter(~F.col("note_id").isin(*SEPARATORS) & ~is_blank(F.col("raw")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return kept.withColumn("n", n).select(*_element("footnote", F.concat(F.lit("footnote_"), "n"), F.col("raw"), F.col("n"), F.col("note_id")))


def union(parts: list[DataFrame]) -> DataFrame:
    """All kinds in one table, with ``pos``: the place in the document by kind, then sequence."""
    every = reduce(DataFrame.unionByName, parts)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("type"))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "seq")).cast("long"))


def pdf_lines(blocks: DataFrame, descending: bool = True) -> DataFrame:
    """(doc_id, page, line, text) of page blocks: numbered by height, then blank ones dropped, so numbers have gaps.

    ``descending``: as extraction numbers them; annotation counts from the top (ascending).
    """
    return numbered_lines(blocks, descending).select("doc_id", "page", "line", "text")


def numbered_lines(blocks: DataFrame, descending: bool = False) -> DataFrame:
    """The same with the blocks' coordinates."""
    y = F.col("y0").desc() if descending else F.col("y0").asc()
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(y, "ord"))
    return blocks.withColumn("line", n).filter(~is_blank(F.col("text"))).select("doc_id", "page", "line", "x0", "y0", "x1", "y1", strip(F.col("text")).alias("text"))


def flatten_pages(structure: DataFrame) -> DataFrame:
    """Nested pages and lines as (doc_id, page, line, text)."""
    return structure.select("doc_id", F.inline("pages")).select("doc_id", "page", F.inline("lines")).select("doc_id", "page", "line", "text")


def from_documents(docs: DataFrame, text: str = "text", header: str | None = None, footer: str | None = None, box=None, note=None, delimiter: str = " | ") -> DataFrame:
    """All elements of texts, with ``pos``, in one pass without a shuffle.

    Numbering happens inside a document's row, on the array of its lines, so
    nothing has to be sorted or moved: the table goes on as it was read.
    ``header`` and ``footer`` name columns; ``box`` and ``note`` are functions
    of a line (struct of pos and raw): whether it is a text box's, and the id
    of the note that it is, or null.
    """
    kind = lambda k, seq, eid, raw, nid=None: F.struct(F.lit(k).alias("type"), seq.cast("long").alias("seq"), eid.alias("element_id"), (F.lit(None).cast("string") if nid is None else nid).alias("footnote_id"), strip(raw).alias("text"))
    lines_ = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("pos"), x.alias("raw")))
    rows = docs.withColumn("__lines", lines_)
    ls = F.col("__lines")
    parts = [F.transform(ls, lambda x: kind("paragraph", x["pos"], F.concat(F.lit("paragraph_"), x["pos"].cast("string")), x["raw"]))]
    tabs = F.filter(ls, lambda x: x["raw"].contains(delimiter))
    cell = lambda r: lambda c, k: kind("table_cell", (r + 1) * 10_000 + k, F.concat_ws("_", F.lit("table_1_cell"), (r + 1).cast("string"), (k + 1).cast("string")), c)
    parts.append(F.flatten(F.transform(tabs, lambda x, r: F.transform(F.split(x["raw"], delimiter.replace("|", r"\|")), cell(r)))))
    parts += [F.array(kind(k, F.lit(1), F.lit(f"{k}_1"), F.col(c))) for k, c in (("header", header), ("footer", footer)) if c]
    if box is not None:
        parts.append(F.transform(F.filter(ls, box), lambda x, i: kind("textbox", i + 1, F.concat(F.lit("textbox_"), (i + 1).cast("string")), x["raw"])))
    if note is not None:
        kept = F.filter(ls, lambda x: note(x).isNotNull() & ~note(x).isin(*SEPARATORS) & ~is_blank(x["raw"]))
        parts.append(F.transform(kept, lambda x, i: kind("footnote", i + 1, F.concat(F.lit("footnote_"), (i + 1).cast("string")), x["raw"], note(x))))
    found = rows.select("doc_id", F.posexplode(F.concat(*parts)).alias("__at", "e"))
    return found.select("doc_id", "e.seq", "e.type", "e.element_id", "e.footnote_id", "e.text", (F.col("e.text") == "").alias("empty"), (F.col("__at") + 1).cast("long").alias("pos"))
