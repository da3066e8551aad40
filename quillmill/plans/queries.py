"""One query per operator, over the fixtures; with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import register
from ..functions import text as tx
from ..operators import batching, diff, jobs, match, package, package_xml, pdf, suggest, tracked
from ..session import fresh_path
from ..sources import elements as el
from ..sources import datasource, jsonio, parts, policy
from . import fixtures as fx
from . import oracle as o
from . import review
from .oracle import q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The fixed "now" of retention queries, and the prompt length of batching queries.
NOW, PROMPT_CHARS, BUDGET = "2024-01-31 00:00:00", 100, 250


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- flagship -------------------------------------------------------------------------------------------------


@query(q("SELECT d.lang, count(*) AS n_changes, count(*) FILTER (WHERE is_exact AND route IN ('paragraph', 'table_cell')) AS n_exact FROM verdict_rows v JOIN documents d ON v.doc_id = d.doc_id GROUP BY d.lang", "verdict_rows"))
def review_by_language(spark, d):
    """Rule-based suggestions, and how many match exactly, per language."""
    v = match.verdicts(fx.changes(spark, d), fx.elements(spark, d))
    return v.join(fx.docs(spark, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_changes"), F.count_if(F.col("verdict") == "exact").alias("n_exact"))


# ---- scans ----------------------------------------------------------------------------------------------------

_EL = "doc_id, seq, element_id, text, empty"


@query(q("SELECT path, CASE WHEN lower(path) LIKE '%.docx' THEN 'docx' ELSE 'pdf' END AS format FROM files WHERE event_id % 5 IN (0, 1, 4)", "files"))
def src_format_dispatch(spark, d):
    return el.dispatch(fx.files(spark, d))[0].select("path", "format")


@query(q("SELECT path, 'unsupported: ' || CASE WHEN event_id % 5 = 2 THEN '.txt' ELSE '' END AS reason FROM files WHERE event_id % 5 IN (2, 3)", "files"))
def src_format_rejects(spark, d):
    return el.dispatch(fx.files(spark, d))[1].select("path", "reason")


@query(q(f"SELECT {_EL} FROM paragraphs", "paragraphs"))
def scan_paragraphs(spark, d):
    return el.paragraphs(fx.lines(spark, d)).select(*_EL.split(", "))


@query(q(f"SELECT {_EL} FROM cells", "cells"))
def scan_table_cells(spark, d):
    return el.table_cells(fx.lines(spark, d)).select(*_EL.split(", "))


@query(q(f"SELECT {_EL}, type FROM elements WHERE type IN ('header', 'footer')", "elements"))
def scan_header_footer(spark, d):
    return el.header_footer(fx.sections(spark, d)).select(*_EL.split(", "), "type")


@query(q(f"SELECT {_EL} FROM elements WHERE type = 'textbox'", "elements"))
def scan_textboxes(spark, d):
    return el.numbered(fx.boxes(spark, d), "textbox").select(*_EL.split(", "))


@query(q(f"SELECT {_EL}, footnote_id FROM elements WHERE type = 'footnote'", "elements"))
def scan_footnotes(spark, d):
    return el.footnotes(fx.notes(spark, d)).select(*_EL.split(", "), "footnote_id")


@query(q(f"SELECT doc_id, page, line, {o.strip('text')} AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, ord) AS line FROM blocks) WHERE {o.strip('text')} <> ''", "blocks"))
def scan_pdf_lines(spark, d):
    return el.pdf_lines(fx.blocks(spark, d)).select("doc_id", F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), "text")


@query(q("SELECT doc_id, page, line, text FROM pdf_lines", "pdf_lines"))
def flatten_pages(spark, d):
    lines = el.pdf_lines(fx.blocks(spark, d), descending=False)
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    nested = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "lines"))).alias("pages"))
    return el.flatten_pages(nested).select("doc_id", F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), "text")


@query(q("SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, ord) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, ord) AS down FROM blocks", "blocks"))
def sort_blocks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page")
    n = lambda *by: F.row_number().over(w.orderBy(*by)).cast("long")
    return fx.blocks(spark, d).select("doc_id", F.col("page").cast("long").alias("page"), F.col("ord").cast("long").alias("ord"), n("y0", "ord").alias("up"), n(F.desc("y0"), "ord").alias("down"))


@query(q("SELECT doc_id, pos, type, element_id, footnote_id, text, empty FROM elements", "elements"))
def elements_union(spark, d):
    return fx.elements(spark, d).select("doc_id", "pos", "type", "element_id", "footnote_id", "text", "empty")


@query(ORACLES["elements_union"])
def elements_by_kind(spark, d):
    return fx.elements_by_kind(spark, d).select("doc_id", "pos", "type", "element_id", "footnote_id", "text", "empty")


@query(q("SELECT doc_id, type, count(*) AS n, count(*) FILTER (WHERE empty) AS n_empty FROM elements GROUP BY doc_id, type", "elements"))
def flag_empty(spark, d):
    return fx.elements(spark, d).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count_if("empty").alias("n_empty"))


_UNMARK = lambda x: o.strip("replace(replace(" + x + ", '<!-- START_LOCKED -->', ''), '<!-- END_LOCKED -->', '')")


@query(
    q(
        f"""SELECT doc_id, e > 0 AS valid, CASE WHEN e > 0 THEN {o.strip("text[s + 23 + 1 : e - 1]")} END AS editable,
          CASE WHEN e > 0 THEN {_UNMARK("text[1 : s - 1]")} END AS locked_before, CASE WHEN e > 0 THEN {_UNMARK("text[e + 21 :]")} END AS locked_after
        FROM (SELECT *, instr(text, '<!-- START_EDITABLE -->') AS s, instr(text, '<!-- END_EDITABLE -->') AS e FROM policies)""".replace("s + 23 + 1", "s + 23"),
        "policies",
    )
)
def prompt_sections(spark, d):
    return policy.sections(fx.policies(spark, d)).select("doc_id", "valid", "editable", "locked_before", "locked_after")


@query(q("SELECT doc_id, contains(text, '<!-- START_LOCKED -->') OR contains(text, '<!-- END_LOCKED -->') OR contains(text, '<!-- START_EDITABLE -->') OR contains(text, '<!-- END_EDITABLE -->') AS forbidden FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN raw ELSE raw || '<!-- END_EDITABLE -->' END AS text FROM lines)", "lines"))
def prompt_forbidden(spark, d):
    edited = F.when(F.col("doc_id") % 2 == 0, F.col("raw")).otherwise(F.concat("raw", F.lit(policy.END_EDITABLE)))
    return fx.lines(spark, d).select("doc_id", policy.forbidden(edited).alias("forbidden"))


# ---- string functions -----------------------------------------------------------------------------------------


@query(q(f"SELECT doc_id, pos, {o.norm('raw')} AS norm, {o.norm_box('raw')} AS box, {o.clean_pdf('raw')} AS pdf, CAST(len({o.split_words('raw')}) AS BIGINT) AS n_words FROM lines", "lines"))
def text_functions(spark, d):
    raw = F.col("raw")
    return fx.lines(spark, d).select("doc_id", "pos", tx.norm(raw).alias("norm"), tx.norm_box(raw).alias("box"), tx.clean_pdf(raw).alias("pdf"), F.size(tx.split_words(raw)).cast("long").alias("n_words"))


@query(q("SELECT doc_id, chunk_id, cleaned FROM (SELECT doc_id, chunk_id, CASE WHEN starts_with(s, '```') THEN cleaned ELSE raw END AS cleaned FROM cleaned)", "cleaned"))
def clean_fences(spark, d):
    return fx.replies(spark, d).select("doc_id", "chunk_id", tx.clean_fences(F.col("raw")).alias("cleaned"))


@query(q(r"SELECT path, CASE WHEN regexp_matches(name, '\.[^.]*$') THEN regexp_replace(name, '\.([^.]*)$', '_klarspråkad.\1') ELSE name || '_klarspråkad' END AS out_name FROM (SELECT path, replace(path, '/up.d/', '') AS name FROM files)", "files"))
def output_name(spark, d):
    return fx.files(spark, d).select("path", tx.output_name(F.replace("path", F.lit("/up.d/"), F.lit(""))).alias("out_name"))


@query(q("SELECT path, strftime(modificationTime, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM files", "files"))
def utc_stamps(spark, d):
    return fx.files(spark, d).select("path", tx.utc_stamp(F.col("modificationTime")).alias("stamp"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE coalesce(CASE WHEN event_id % 3 = 1 THEN value END, 0.7) END::DOUBLE AS temperature FROM events")
def effective_temperature(spark, d):
    k = F.col("event_id") % 3
    model = F.when(k == 0, "gpt-5-mini").otherwise("gpt-4o")
    return fx.table(spark, d, "events").select("event_id", suggest.effective_temperature(model, F.when(k == 1, F.col("value"))).alias("temperature"))


# ---- batches and replies --------------------------------------------------------------------------------------

_SIZE = "CAST(length(text) AS BIGINT)"


@query(
    q(
        f"""SELECT doc_id, pos, chunk AS chunk_id FROM walk""",
        "paragraphs",
    ).replace(
        "SELECT doc_id, pos, chunk AS chunk_id FROM walk",
        f""", walk(doc_id, pos, used, chunk) AS (
          SELECT doc_id, seq, {PROMPT_CHARS} + {_SIZE}, CAST(0 AS BIGINT) FROM paragraphs WHERE seq = 1
          UNION ALL
          SELECT p.doc_id, p.seq, CASE WHEN w.used + {_SIZE} > {BUDGET * 4} THEN {PROMPT_CHARS} ELSE w.used END + {_SIZE},
            w.chunk + CASE WHEN w.used + {_SIZE} > {BUDGET * 4} THEN 1 ELSE 0 END
          FROM walk w JOIN paragraphs p ON p.doc_id = w.doc_id AND p.seq = w.pos + 1)
        SELECT doc_id, pos, chunk AS chunk_id FROM walk""",
    )
)
def chunk_greedy(spark, d):
    return batching.chunk_greedy(el.paragraphs(fx.lines(spark, d)), F.length("text"), PROMPT_CHARS, BUDGET, "seq").select("doc_id", "pos", "chunk_id")


ORACLES["batch_counts"] = ORACLES["chunk_greedy"].replace("SELECT doc_id, pos, chunk AS chunk_id FROM walk", "SELECT doc_id, max(chunk) + 1 AS n_batches FROM walk GROUP BY doc_id")


@query(ORACLES["batch_counts"])
def batch_counts(spark, d):
    return batching.batch_counts(chunk_greedy(spark, d))


@query(
    q(
        """SELECT doc_id, seq AS pos, CAST(length('{"type": "paragraph", "element_id": "' || element_id || '", "text": ' || to_json(text) || ', "empty": ' || CASE WHEN empty THEN 'true' ELSE 'false' END || '}') AS BIGINT) AS json_length FROM paragraphs""",
        "paragraphs",
    )
)
def json_lengths(spark, d):
    return el.paragraphs(fx.lines(spark, d)).select("doc_id", F.col("seq").alias("pos"), batching.element_length().cast("long").alias("json_length"))


@query(
    q(
        """SELECT doc_id, chunk_id, CASE WHEN NOT ok THEN 'failed' WHEN NOT starts_with(cleaned, '[') THEN 'not an array' ELSE 'ok' END AS outcome,
          CAST(CASE WHEN ok AND starts_with(cleaned, '[') THEN json_array_length(cleaned) ELSE 0 END AS BIGINT) AS n_items FROM cleaned""",
        "cleaned",
    )
)
def batch_outcomes(spark, d):
    return suggest.batch_outcomes(fx.replies(spark, d))


_ITEMS = """SELECT doc_id, chunk_id, pos, json_extract_string(item, '$.element_id') AS element_id, json_extract_string(item, '$.page') AS page, json_extract_string(item, '$.old') AS old
  FROM (SELECT doc_id, chunk_id, generate_subscripts(items, 1) - 1 AS pos, unnest(items) AS item FROM (
    SELECT doc_id, chunk_id, CAST(json_extract(cleaned, '$[*]') AS JSON[]) AS items FROM cleaned WHERE ok AND starts_with(cleaned, '[')))"""


@query(q(f"SELECT doc_id, chunk_id, pos, element_id, CAST(page AS BIGINT) AS page, old, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, pos) AS change_no FROM ({_ITEMS}) WHERE TRY_CAST(page AS BIGINT) IS NOT NULL", "cleaned"))
def concat_batches(spark, d):
    items, _ = suggest.parse_replies(fx.replies(spark, d))
    return batching.concat_batches(items).select("doc_id", "chunk_id", "pos", "element_id", F.col("page").cast("long").alias("page"), "old", "change_no")


@query(q(f"SELECT doc_id, chunk_id, CAST(NULL AS BIGINT) AS pos, CASE WHEN NOT ok THEN 'failed' ELSE 'not an array' END AS reason FROM cleaned WHERE NOT ok OR NOT starts_with(cleaned, '[') UNION ALL SELECT doc_id, chunk_id, pos, 'page or line is no integer' FROM ({_ITEMS}) WHERE TRY_CAST(page AS BIGINT) IS NULL", "cleaned"))
def reply_rejects(spark, d):
    return suggest.parse_replies(fx.replies(spark, d))[1].select("doc_id", "chunk_id", "pos", "reason")


@query(q(f"SELECT doc_id, seq AS change_no, element_id, w AS old, {o.REPLACED} AS new FROM (SELECT *, {o.FIRST_WORD} AS w FROM paragraphs) WHERE w IS NOT NULL", "paragraphs"))
def suggest_rules(spark, d):
    """Suggestions for every paragraph with a word of the lexicon."""
    old, new = suggest.first_match(F.col("text"), fx.LEXICON)
    return el.paragraphs(fx.lines(spark, d)).select("doc_id", F.col("seq").alias("change_no"), "element_id", old.alias("old"), new.alias("new")).filter("old IS NOT NULL")


# ---- joins and matching ---------------------------------------------------------------------------------------


@query(q("SELECT doc_id, change_no, element_id FROM changes c WHERE EXISTS (SELECT 1 FROM elements e WHERE e.doc_id = c.doc_id AND e.element_id = c.element_id)", "changes", "elements"))
def changes_known(spark, d):
    return match.known(fx.changes(spark, d), fx.elements(spark, d)).select("doc_id", "change_no", "element_id")


@query(q("SELECT doc_id, change_no, element_id FROM changes c WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.doc_id = c.doc_id AND e.element_id = c.element_id)", "changes", "elements"))
def anti_unknown_changes(spark, d):
    return match.unknown(fx.changes(spark, d), fx.elements(spark, d)).select("doc_id", "change_no", "element_id")


@query(q("SELECT c.doc_id, c.change_no, c.element_id, e.type AS element_type, e.text FROM changes c JOIN elements e ON c.doc_id = e.doc_id AND c.element_id = e.element_id", "changes", "elements"))
def join_changes_elements(spark, d):
    return match.with_elements(fx.changes(spark, d), fx.elements(spark, d)).select("doc_id", "change_no", "element_id", "element_type", "text")


@query(q("SELECT route, count(*) AS n FROM verdict_rows GROUP BY route", "verdict_rows"))
def route_changes(spark, d):
    return fx.changes(spark, d).groupBy(match.route(F.coalesce("element_id", F.lit(""))).alias("route")).agg(F.count("*").alias("n"))


@query(q("SELECT doc_id, change_no, is_exact AS exact FROM verdict_rows WHERE text IS NOT NULL AND old IS NOT NULL", "verdict_rows"))
def match_exact(spark, d):
    return match.with_elements(fx.changes(spark, d), fx.elements(spark, d)).filter("old IS NOT NULL").select("doc_id", "change_no", match.exact(F.col("text"), F.col("old")).alias("exact"))


@query(q(f"SELECT doc_id, change_no, element_id, CAST(round_even(100.0 * (length({o.norm('text')}) - 1) / length({o.norm('text')}), 0) AS BIGINT) AS score FROM verdict_names WHERE verdict = 'fuzzy'", "verdict_names"))
def match_fuzzy(spark, d):
    joined = match.with_elements(fx.changes(spark, d), fx.elements(spark, d)).filter("old IS NOT NULL")
    return match.fuzzy(joined.filter(~match.exact(F.col("text"), F.col("old")))).select("doc_id", "change_no", "element_id", F.col("score").cast("long").alias("score"))


@query(q(f"SELECT doc_id, change_no, regexp_matches({o.norm('old')}, '^[0-9]+$') OR length({o.norm('old')}) < 4 AS guarded FROM changes WHERE old IS NOT NULL", "changes"))
def guard_short_numeric(spark, d):
    return fx.changes(spark, d).filter("old IS NOT NULL").select("doc_id", "change_no", match.short_or_numeric(F.col("old")).alias("guarded"))


@query(q("SELECT doc_id, change_no, element_id, route, verdict FROM verdict_names", "verdict_names"))
def match_verdicts(spark, d):
    return match.verdicts(fx.changes(spark, d), fx.elements(spark, d)).select("doc_id", "change_no", "element_id", "route", "verdict")


@query()
def match_cells(spark, d):
    return match.cell_matches(fx.cell_changes(spark, d), fx.cell_paragraphs(spark, d))


@query(q("SELECT doc_id, change_no, element_id, coalesce(motivation, '') <> '' AND NOT contains(element_id, 'header') AND NOT contains(element_id, 'footer') AS eligible FROM changes", "changes"))
def comment_eligible(spark, d):
    return fx.changes(spark, d).select("doc_id", "change_no", "element_id", match.comment_eligible(F.col("motivation"), F.col("element_id")).alias("eligible"))


@query(q("SELECT c.doc_id, c.change_no, c.footnote_id, c.new, e.text AS baseline FROM changes c JOIN elements e ON c.doc_id = e.doc_id AND c.footnote_id = e.footnote_id WHERE c.footnote_id IS NOT NULL", "changes", "elements"))
def join_footnotes(spark, d):
    rows = fx.changes(spark, d).filter("footnote_id IS NOT NULL")
    return match.join_footnotes(rows, el.footnotes(fx.notes(spark, d))).select("doc_id", "change_no", "footnote_id", "new", "baseline")


@query(q("SELECT c.doc_id, c.change_no, 0 AS ord, 'strike' AS kind, e.text AS val FROM changes c JOIN elements e ON c.doc_id = e.doc_id AND c.footnote_id = e.footnote_id UNION ALL SELECT c.doc_id, c.change_no, 1, 'insert', coalesce(c.new, '') FROM changes c JOIN elements e ON c.doc_id = e.doc_id AND c.footnote_id = e.footnote_id", "changes", "elements"))
def diff_footnote(spark, d):
    rows = join_footnotes(spark, d).withColumn("segments", diff.diff_footnote(F.col("baseline"), F.col("new")))
    return diff.explode_segments(rows, "doc_id", "change_no").withColumn("ord", F.col("ord").cast("long"))


@query(
    q(
        f"""SELECT c.doc_id, c.change_no, b.element_id AS box_id, c.element_id <> b.element_id AS other_box
        FROM changes c JOIN (SELECT * FROM elements WHERE type = 'textbox') b ON c.doc_id = b.doc_id AND contains({o.norm_box("b.text")}, {o.norm_box("c.old")})
        WHERE starts_with(c.element_id, 'textbox_') QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.change_no ORDER BY b.seq) = 1""",
        "changes",
        "elements",
    )
)
def join_textbox_contains(spark, d):
    rows = fx.changes(spark, d).filter(F.col("element_id").startswith("textbox_"))
    return match.join_textboxes(rows, el.numbered(fx.boxes(spark, d), "textbox")).select("doc_id", "change_no", "box_id", "other_box")


_LITERAL = "substr(text, 1, instr(text, old) - 1) || coalesce(new, '') || substr(text, instr(text, old) + length(old))"


@query(q(f"SELECT doc_id, change_no, {_LITERAL} AS result FROM verdict_rows WHERE text IS NOT NULL AND old <> '' AND instr(text, old) > 0", "verdict_rows"))
def apply_replacement(spark, d):
    rows = match.with_elements(fx.changes(spark, d), fx.elements(spark, d))
    return rows.select("doc_id", "change_no", match.literal_replacement(F.col("text"), F.col("old"), F.col("new")).alias("result")).filter("result IS NOT NULL")


def _matched(spark, d):
    rows = match.verdicts(fx.changes(spark, d), fx.elements(spark, d))
    return rows.filter(F.col("verdict").isin("exact", "fuzzy"))


@query(q("SELECT doc_id, change_no, 'rewritten' AS result FROM verdict_names WHERE verdict = 'fuzzy'", "verdict_names"))
def replace_fuzzy(spark, d):
    return match.replacement(_matched(spark, d).filter("verdict = 'fuzzy'")).select("doc_id", "change_no", "result")


_FIRST = f"CASE verdict WHEN 'fuzzy' THEN 'rewritten' ELSE {_LITERAL} END"
_THEN = "CASE WHEN verdict = 'fuzzy' THEN 'rewritten' WHEN instr(w.result, m.old) > 0 THEN substr(w.result, 1, instr(w.result, m.old) - 1) || coalesce(m.new, '') || substr(w.result, instr(w.result, m.old) + length(m.old)) ELSE coalesce(m.new, '') END"


@query(
    q("", "verdict_names")
    + f""", matched AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, element_id ORDER BY change_no) AS n, count(*) OVER (PARTITION BY doc_id, element_id) AS n_changes FROM verdict_names WHERE verdict IN ('exact', 'fuzzy')),
    walk(doc_id, element_id, n, n_changes, result) AS (
      SELECT doc_id, element_id, n, n_changes, {_FIRST} FROM matched WHERE n = 1
      UNION ALL
      SELECT w.doc_id, w.element_id, m.n, w.n_changes, {_THEN} FROM walk w JOIN matched m ON m.doc_id = w.doc_id AND m.element_id = w.element_id AND m.n = w.n + 1)
    SELECT doc_id, element_id, result, n_changes, n_changes > 1 AS conflict FROM walk WHERE n = n_changes"""
)
def apply_sequential(spark, d):
    return match.apply_sequential(_matched(spark, d)).select("doc_id", "element_id", "result", "n_changes", "conflict")


@query()
def word_diff(spark, d):
    rows = fx.changes(spark, d).filter("old IS NOT NULL")
    return diff.explode_segments(diff.diff_words(rows), "doc_id", "change_no")


@query()
def diff_paragraph(spark, d):
    return diff.explode_segments(diff.diff_paragraph(_matched(spark, d).filter("route = 'paragraph'")), "doc_id", "change_no")


@query()
def diff_cell(spark, d):
    hits = match.cell_matches(fx.cell_changes(spark, d), fx.cell_paragraphs(spark, d)).select("doc_id", "change_no", "par_no")
    return diff.explode_segments(diff.diff_words(fx.cell_changes(spark, d).join(hits, ["doc_id", "change_no"])), "doc_id", "change_no", "par_no")


@query()
def diff_cell_paragraph(spark, d):
    """The matched paragraph of a cell against its replaced text: what stands around the change stays."""
    hits = match.cell_matches(fx.cell_changes(spark, d), fx.cell_paragraphs(spark, d)).select("doc_id", "change_no", "par_no")
    rows = fx.cell_changes(spark, d).join(hits, ["doc_id", "change_no"]).join(fx.cell_paragraphs(spark, d), ["doc_id", "element_id", "par_no"])
    return diff.explode_segments(diff.diff_paragraph(rows), "doc_id", "change_no", "par_no")


@query()
def diff_textbox_full(spark, d):
    """A box's whole text against its replaced text."""
    rows = fx.changes(spark, d).filter(F.col("element_id").startswith("textbox_"))
    found = match.join_textboxes(rows, el.numbered(fx.boxes(spark, d), "textbox"))
    return diff.explode_segments(diff.diff_paragraph(found.withColumnRenamed("box_text", "text")), "doc_id", "change_no", "box_id")


@query()
def diff_textbox(spark, d):
    rows = fx.changes(spark, d).filter(F.col("element_id").startswith("textbox_"))
    return diff.explode_segments(diff.diff_words(match.join_textboxes(rows, el.numbered(fx.boxes(spark, d), "textbox"))), "doc_id", "change_no", "box_id")


@query(q("SELECT doc_id, change_no, element_id, verdict FROM verdict_names WHERE verdict NOT IN ('exact', 'fuzzy', 'deferred')", "verdict_names"))
def report_unapplied(spark, d):
    return match.unapplied(match.verdicts(fx.changes(spark, d), fx.elements(spark, d)))


@query(q("SELECT doc_id, count(*) AS n_changes, count(*) FILTER (WHERE verdict = 'exact') AS n_exact, count(*) FILTER (WHERE verdict = 'fuzzy') AS n_fuzzy, count(*) FILTER (WHERE verdict = 'deferred') AS n_deferred, count(*) FILTER (WHERE verdict NOT IN ('exact', 'fuzzy', 'deferred')) AS n_unapplied FROM verdict_names GROUP BY doc_id", "verdict_names"))
def edit_summary(spark, d):
    return match.summary(match.verdicts(fx.changes(spark, d), fx.elements(spark, d)))


# ---- pdf ------------------------------------------------------------------------------------------------------


def _pdf(spark, d):
    return pdf.valid(fx.pdf_changes(spark, d), fx.page_counts(spark, d)), el.pdf_lines(fx.blocks(spark, d), descending=False)


_L = lambda c: F.col(c).cast("long").alias(c)


@query(q("SELECT doc_id, change_no, page, line, old FROM pdf_valid", "pdf_valid"))
def changes_pdf_valid(spark, d):
    return _pdf(spark, d)[0].select("doc_id", "change_no", _L("page"), _L("line"), "old")


@query(q("SELECT * FROM pdf_exact", "pdf_exact"))
def join_pdf_exact_line(spark, d):
    return pdf.exact_line(*_pdf(spark, d)).select("doc_id", "change_no", _L("page"), _L("line"), "text")


@query(
    q(
        f"""SELECT c.doc_id, c.change_no, c.page, c.line AS target, l.line FROM pdf_valid c JOIN pdf_lines l ON c.doc_id = l.doc_id AND c.page = l.page AND abs(l.line - c.line) <= 2
        WHERE c.line <> 0 AND (contains({o.norm(o.clean_pdf("l.text"))}, {o.norm("c.old")}) OR contains({o.norm(o.clean_pdf("c.old"))}, {o.norm(o.clean_pdf("l.text"))}))
          AND NOT EXISTS (SELECT 1 FROM pdf_exact x WHERE x.doc_id = c.doc_id AND x.change_no = c.change_no)
        QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.change_no ORDER BY l.line) = 1""",
        "pdf_valid",
        "pdf_lines",
        "pdf_exact",
    )
)
def join_pdf_near_line(spark, d):
    return pdf.near_line(*_pdf(spark, d)).select("doc_id", "change_no", _L("page"), _L("target"), _L("line"))


@query(q("SELECT c.doc_id, c.change_no, c.page, l.line FROM pdf_valid c JOIN pdf_lines l ON c.doc_id = l.doc_id AND c.page = l.page WHERE (c.line IS NULL OR c.line = 0) AND c.old <> '' AND contains(lower(l.text), lower(c.old))", "pdf_valid", "pdf_lines"))
def join_pdf_page(spark, d):
    return pdf.on_page(*_pdf(spark, d)).select("doc_id", "change_no", _L("page"), _L("line"))


@query(q(f"SELECT doc_id, pos, contains({o.norm(o.clean_pdf('raw'))}, {o.norm('other')}) OR contains({o.norm(o.clean_pdf('other'))}, {o.norm(o.clean_pdf('raw'))}) AS holds FROM (SELECT *, lang || '' AS other FROM lines JOIN documents USING (doc_id))", "lines"))
def pdf_contains(spark, d):
    rows = fx.lines(spark, d).join(fx.docs(spark, d).select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", "pos", pdf.holds(F.col("raw"), F.col("lang")).alias("holds"))


@query(q("SELECT doc_id, change_no, CASE WHEN coalesce(new, '') <> '' THEN 'Förslag: ' || new || ' ' || chr(10) || chr(10) || 'Motivering: ' || coalesce(motivation, '') END AS note, CASE WHEN coalesce(new, '') <> '' THEN 'Förslag: ' || new END AS short_note FROM pdf_changes", "pdf_changes"))
def annotation_text(spark, d):
    return fx.pdf_changes(spark, d).select("doc_id", "change_no", pdf.note(F.col("new"), F.col("motivation")).alias("note"), pdf.note(F.col("new"), F.col("motivation"), False).alias("short_note"))


_CLOSE = " AND ".join(f"abs(k.{c} - a.{c}) < 5" for c in ("x0", "y0", "x1", "y1"))


@query(
    q("", "annotations")
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS n FROM annotations),
    walk(doc_id, page, n, kept) AS (
      SELECT doc_id, page, n, [struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, t := trim(content), ord := ord)] FROM ranked WHERE n = 1
      UNION ALL
      SELECT w.doc_id, w.page, a.n, CASE WHEN len(list_filter(w.kept, lambda k: k.t = trim(a.content) OR ({_CLOSE}))) > 0 THEN w.kept
        ELSE list_append(w.kept, struct_pack(x0 := a.x0, y0 := a.y0, x1 := a.x1, y1 := a.y1, t := trim(a.content), ord := a.ord)) END
      FROM walk w JOIN ranked a ON a.doc_id = w.doc_id AND a.page = w.page AND a.n = w.n + 1),
    last AS (SELECT doc_id, page, kept FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC) = 1)
    SELECT doc_id, page, k.ord AS ord FROM (SELECT doc_id, page, unnest(kept) AS k FROM last)"""
)
def annotations_dedupe(spark, d):
    return pdf.dedupe_notes(fx.annotations(spark, d)).select("doc_id", _L("page"), _L("ord"))


@query(
    q(
        f"""SELECT c.doc_id, c.change_no, CASE WHEN NOT EXISTS (SELECT 1 FROM pdf_valid v WHERE v.doc_id = c.doc_id AND v.change_no = c.change_no) THEN 'invalid' WHEN EXISTS (
            SELECT 1 FROM pdf_lines l WHERE l.doc_id = c.doc_id AND l.page = c.page AND CASE WHEN coalesce(c.line, 0) = 0 THEN c.old <> '' AND contains(lower(l.text), lower(c.old))
              ELSE abs(l.line - c.line) <= 2 AND (contains({o.norm(o.clean_pdf("l.text"))}, {o.norm("c.old")}) OR contains({o.norm(o.clean_pdf("c.old"))}, {o.norm(o.clean_pdf("l.text"))})) END) THEN 'matched' ELSE 'no match' END AS outcome
          FROM pdf_changes c""",
        "pdf_changes",
        "pdf_valid",
        "pdf_lines",
    )
)
def page_outcomes(spark, d):
    """Every change of a page once: as notes (or repeats of them), or as a reject with its reason."""
    notes, rejects = pdf.annotate(fx.pdf_changes(spark, d), fx.blocks(spark, d))
    noted = notes.select("doc_id", "change_no").distinct().withColumn("outcome", F.lit("matched"))
    return noted.union(rejects.select("doc_id", "change_no", F.when(F.col("reason") == "duplicate", "matched").otherwise(F.col("reason"))))


@query()
def page_notes(spark, d):
    """The notes of all pages, without duplicates."""
    notes, _ = pdf.annotate(fx.pdf_changes(spark, d), fx.blocks(spark, d))
    return notes.select("doc_id", _L("page"), "change_no", "y0", "content")


# ---- runs and tracked changes ---------------------------------------------------------------------------------


@query(q("SELECT doc_id, para_no, run_no, CASE WHEN color = 'FF0000' AND strike THEN 'del' WHEN color = '008000' THEN 'ins' END AS kind FROM runs", "runs"))
def classify_runs(spark, d):
    return fx.runs(spark, d).select("doc_id", _L("para_no"), _L("run_no"), tracked.change_kind(F.col("color"), F.col("strike")).alias("kind"))


_TRACKED = "SELECT *, CASE WHEN color = 'FF0000' AND strike THEN 'del' ELSE 'ins' END AS kind, row_number() OVER (PARTITION BY doc_id, part_name ORDER BY para_no, run_no) AS change_id FROM runs WHERE (color = 'FF0000' AND strike) OR color = '008000'"


@query(q(f"SELECT doc_id, part_name, para_no, run_no, kind, change_id FROM ({_TRACKED})", "runs"))
def tracked_ids(spark, d):
    return tracked.tracked_ids(fx.runs(spark, d)).select("doc_id", "part_name", _L("para_no"), _L("run_no"), "kind", "change_id")


@query(q(f"SELECT doc_id, para_no, run_no, change_id, kind, CASE WHEN right(text, 1) IN (' ', '.', ',', ';', ':', '!', '?', '”', '’') THEN text ELSE text || ' ' END AS text, comment_ref FROM ({_TRACKED}) WHERE part_name = 'word/document.xml'", "runs"))
def tracked_segments(spark, d):
    return tracked.tracked_segments(fx.runs(spark, d)).select("doc_id", _L("para_no"), _L("run_no"), "change_id", "kind", "text", "comment_ref")


@query(q("SELECT doc_id, para_no, run_no, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id, para_no ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars FROM runs", "runs"))
def run_offsets(spark, d):
    return diff.run_offsets(fx.runs(spark, d)).select("doc_id", _L("para_no"), _L("run_no"), F.col("offset").alias("offset_chars"))


@query(
    q(
        """SELECT r.doc_id, r.change_no, r.ref_id, min(s.ord) AS slot FROM refs r LEFT JOIN (
          SELECT *, sum(CASE WHEN kind = 'insert' THEN 0 ELSE length(val) END) OVER (PARTITION BY doc_id, change_no ORDER BY ord) AS so_far FROM segments) s
          ON r.doc_id = s.doc_id AND r.change_no = s.change_no AND s.so_far >= r.off GROUP BY r.doc_id, r.change_no, r.ref_id""",
        "refs",
        "segments",
    )
)
def footnote_ref_slots(spark, d):
    return diff.footnote_slots(fx.edit_segments(spark, d), fx.edit_refs(spark, d)).select("doc_id", "change_no", "ref_id", "slot")


@query(q("SELECT doc_id, para_no, footnote_ref, after_run FROM (SELECT *, coalesce(lead(run_no) OVER (PARTITION BY doc_id, para_no ORDER BY run_no), run_no) AS after_run FROM runs) WHERE footnote_ref IS NOT NULL", "runs"))
def anchor_comment_position(spark, d):
    return diff.anchor_positions(fx.runs(spark, d)).select("doc_id", _L("para_no"), "footnote_ref", "after_run")


@query(q("SELECT doc_id, para_no, string_agg(text, ' ' ORDER BY run_no) AS text FROM runs GROUP BY doc_id, para_no", "runs"))
def concat_runs(spark, d):
    return diff.concat_runs(fx.runs(spark, d), " ").select("doc_id", _L("para_no"), "text")


@query(q("SELECT doc_id, pos AS para_no, CAST(floor((pos - 1) / 3) AS BIGINT) AS group_no, upper(sha256(doc_id || ':' || CAST(floor((pos - 1) / 3) AS BIGINT))[1:8]) AS rsid FROM lines", "lines"))
def paragraph_groups(spark, d):
    return tracked.paragraph_groups(fx.lines(spark, d).select("doc_id", F.col("pos").alias("para_no")))


# ---- packages -------------------------------------------------------------------------------------------------


@query(q("SELECT doc_id, style_id, name FROM named_styles", "named_styles"))
def join_style_translate(spark, d):
    return package.translate_styles(fx.styles(spark, d)).select("doc_id", "style_id", "name")


@query(q("SELECT * FROM missing_styles", "missing_styles"))
def check_styles(spark, d):
    return package.missing_styles(fx.doc_ids(spark, d), fx.styles(spark, d)).select("doc_id", "style")


@query(q("SELECT r.doc_id, r.style FROM required_styles r WHERE NOT EXISTS (SELECT 1 FROM styles s WHERE s.doc_id = r.doc_id AND s.style_id = r.style)", "required_styles", "styles"))
def except_required_styles(spark, d):
    have = fx.styles(spark, d).select("doc_id", F.col("style_id").alias("style"))
    return package.missing(fx.doc_ids(spark, d), package.REQUIRED_STYLES, have, "style")


@query(q("SELECT * FROM missing_targets", "missing_targets"))
def check_relationship_targets(spark, d):
    return package.missing_targets(fx.doc_ids(spark, d), fx.rels(spark, d)).select("doc_id", "target")


_NO_PART = lambda p: f"NOT EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = d.doc_id AND p.part_name = '{p}')"
_NO_FLAG = "NOT EXISTS (SELECT 1 FROM settings s WHERE s.doc_id = d.doc_id AND s.name = 'trackRevisions')"


@query(q(f"SELECT doc_id, CASE WHEN {_NO_PART('word/settings.xml')} THEN 'missing settings.xml' ELSE 'missing trackRevisions' END AS detail FROM documents d WHERE {_NO_PART('word/settings.xml')} OR {_NO_FLAG}", "parts", "settings"))
def check_settings(spark, d):
    return package.check_settings(fx.doc_ids(spark, d), fx.parts(spark, d), fx.settings(spark, d))


@query(q("SELECT * FROM orphans", "orphans"))
def anti_orphan_comment_refs(spark, d):
    return package.orphan_references(fx.comment_refs(spark, d), fx.comments(spark, d)).select("doc_id", "comment_id")


@query(q("SELECT doc_id, comment_id, text, false AS made FROM comments UNION ALL SELECT DISTINCT doc_id, comment_id, '(missing comment)', true FROM orphans", "comments", "orphans"))
def upsert_missing_comments(spark, d):
    return package.with_missing_comments(fx.comments(spark, d), fx.comment_refs(spark, d)).select("doc_id", "comment_id", "text", "made")


@query(q("SELECT doc_id, coalesce(max(TRY_CAST(comment_id AS BIGINT)), -1) + 1 AS next_id FROM comments GROUP BY doc_id", "comments"))
def next_comment_id(spark, d):
    return package.next_comment_id(fx.comments(spark, d))


@query(q("SELECT doc_id, 'rId' || min(n) AS free_rid FROM (SELECT DISTINCT doc_id FROM rels), range(1, 12) t(n) WHERE 'rId' || n NOT IN (SELECT rid FROM rels r WHERE r.doc_id = doc_id) GROUP BY doc_id", "rels").replace("(SELECT DISTINCT doc_id FROM rels), range(1, 12) t(n) WHERE 'rId' || n NOT IN (SELECT rid FROM rels r WHERE r.doc_id = doc_id)", "(SELECT DISTINCT doc_id FROM rels) x, range(1, 12) t(n) WHERE NOT EXISTS (SELECT 1 FROM rels r WHERE r.doc_id = x.doc_id AND r.rid = 'rId' || n)"))
def first_free_rid(spark, d):
    return package.first_free_rid(fx.rels(spark, d))


@query(q(f"SELECT doc_id, part_name, content_type, false AS added FROM overrides UNION ALL SELECT d.doc_id, v.part_name, v.content_type, true FROM documents d, {o.values(package.COMMENT_OVERRIDES, 'part_name, content_type')} WHERE NOT EXISTS (SELECT 1 FROM overrides x WHERE x.doc_id = d.doc_id AND x.part_name = v.part_name)", "overrides"))
def add_if_absent(spark, d):
    return package.add_if_absent(fx.overrides(spark, d), package.required_overrides(fx.doc_ids(spark, d)), ["doc_id", "part_name"])


@query(q(f"SELECT doc_id, target, rid, false AS added FROM rels UNION ALL SELECT d.doc_id, v.target, v.rid, true FROM documents d, {o.values([(t, i) for t, _, i in package.COMMENT_RELATIONSHIPS], 'target, rid')}", "rels"))
def add_relationships(spark, d):
    required = package.required_relationships(fx.doc_ids(spark, d)).select("doc_id", "target", "rid")
    return package.add_if_absent(fx.rels(spark, d), required, ["doc_id", "target"])


_MERGED = ", ".join(o.literal(p) for p in package.MERGED_PARTS)


@query(q(f"SELECT doc_id, part_name, content, false AS added FROM parts UNION ALL SELECT doc_id, part_name, content, true FROM source_parts s WHERE (part_name IN ({_MERGED}) OR starts_with(part_name, 'customXml/')) AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = s.doc_id AND p.part_name = s.part_name)", "parts", "source_parts"))
def merge_missing_parts(spark, d):
    return package.merge_missing_parts(fx.parts(spark, d), fx.source_parts(spark, d))


@query(q("SELECT doc_id, count(*) AS n_paragraphs, CASE WHEN count(*) < 20 THEN 50 WHEN count(*) < 100 THEN 100 ELSE 200 END AS n_rsids FROM lines GROUP BY doc_id", "lines"))
def rsid_bucket(spark, d):
    return package.rsid_bucket(fx.lines(spark, d))


@query(q("SELECT d.doc_id, (SELECT count(*) FROM required_styles r WHERE r.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM styles s WHERE s.doc_id = r.doc_id AND s.style_id = r.style)) AS n_missing_styles, NOT " + _NO_FLAG + " AS track_revisions, coalesce(n, 0) AS n_rsids, coalesce(n, 0) < 10 AS sparse_rsids FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT rsid) AS n FROM rsids GROUP BY doc_id) USING (doc_id)", "required_styles", "styles", "settings", "rsids"))
def qc_report(spark, d):
    return package.qc_report(fx.doc_ids(spark, d), fx.styles(spark, d), fx.settings(spark, d), fx.rsids(spark, d))


_HAS = lambda p, a: f"EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = {a}.doc_id AND p.part_name = '{p}')"


@query(
    q(
        f"""SELECT doc_id, 'relationships' AS rule, 'error' AS severity, 'missing document.xml.rels' AS detail FROM documents d WHERE {_NO_PART("word/_rels/document.xml.rels")}
        UNION ALL SELECT doc_id, 'relationships', 'warning', 'missing relationship to ' || target FROM missing_targets m WHERE {_HAS("word/_rels/document.xml.rels", "m")}
        UNION ALL SELECT doc_id, 'styles', 'error', 'missing styles.xml' FROM documents d WHERE {_NO_PART("word/styles.xml")}
        UNION ALL SELECT doc_id, 'styles', 'warning', 'missing style ' || style FROM missing_styles m WHERE {_HAS("word/styles.xml", "m")}
        UNION ALL SELECT doc_id, 'settings', 'error', 'missing settings.xml' FROM documents d WHERE {_NO_PART("word/settings.xml")}
        UNION ALL SELECT doc_id, 'settings', 'warning', 'missing trackRevisions' FROM documents d WHERE {_HAS("word/settings.xml", "d")} AND {_NO_FLAG}
        UNION ALL SELECT doc_id, 'comments', 'warning', 'no comment for reference ' || comment_id FROM orphans m WHERE {_HAS("word/comments.xml", "m")}
        UNION ALL SELECT doc_id, 'wellformed', 'error', 'word/broken.xml: no element found: line 1, column 6' FROM documents WHERE doc_id % 50 = 49 AND doc_id % 100 <> 99""",
        "parts",
        "missing_targets",
        "missing_styles",
        "settings",
        "orphans",
    )
)
def validate_package(spark, d):
    nodes = parts.scan_nodes(parts.scan_parts(fx.packages(spark, d)).filter("error IS NULL"))
    malformed = nodes.filter("kind = 'malformed'").select(F.regexp_extract("path", r"doc(\d+)", 1).cast("long").alias("doc_id"), "part_name", "error")
    return package.validate(fx.doc_ids(spark, d), fx.parts(spark, d), fx.rels(spark, d), fx.styles(spark, d), fx.settings(spark, d), fx.comments(spark, d), fx.comment_refs(spark, d), malformed)


@query(q("SELECT doc_id, node, parent, tag, n_children FROM nodes n WHERE tag NOT IN ('proofErr', 'noProof') AND (tag <> 'rPr' OR n_children > (SELECT count(*) FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent = n.node AND c.tag IN ('proofErr', 'noProof')))", "nodes"))
def clean_nodes(spark, d):
    return package.clean_nodes(fx.nodes(spark, d)).select("doc_id", "node", "parent", "tag", "n_children")


@query(q("SELECT doc_id, pos AS para_no, CASE WHEN pos % 3 = 0 AND pos % 5 <> 0 THEN 'Normal' WHEN pos % 3 <> 0 THEN 'Own' END AS style, pos % 3 = 0 AND pos % 5 <> 0 AS fixed FROM lines", "lines"))
def default_pstyle(spark, d):
    return package.default_style(fx.styled_paragraphs(spark, d)).select("doc_id", "para_no", "style", "fixed")


_PLAN = [(1, "create word/comments.xml", "word/comments.xml", False), *[(2, f"create {p}", p, False) for p in package.COMMENT_PARTS], (3, "add comment relationships", "word/_rels/document.xml.rels", True), (4, "add comment overrides", "[Content_Types].xml", True), (5, "drop orphan comment references", "word/document.xml", True), (6, "add track flag and rsids", "word/settings.xml", True), (7, "create word/styles.xml", "word/styles.xml", False)]


@query(q(f"SELECT d.doc_id, CAST(v.step AS BIGINT) AS step, v.action FROM documents d, {o.values([(s, a, p, str(h).lower()) for s, a, p, h in _PLAN], 'step, action, part, there')} WHERE EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = d.doc_id AND p.part_name = v.part) = CAST(v.there AS BOOLEAN) UNION ALL SELECT doc_id, 8, 'add required styles' FROM documents", "parts"))
def repair_plan(spark, d):
    return package.repair_plan(fx.doc_ids(spark, d), fx.parts(spark, d))


@query(q(f"SELECT doc_id, 'word/comments.xml' AS part_name FROM documents d WHERE {_NO_PART('word/comments.xml')}", "parts"))
def repair_comments_part(spark, d):
    return package.missing(fx.doc_ids(spark, d), ("word/comments.xml",), fx.parts(spark, d), "part_name")


# ---- jobs -----------------------------------------------------------------------------------------------------


@query(q("SELECT job_id, seq, status, done, error FROM jobs", "jobs"))
def job_latest_status(spark, d):
    return jobs.latest_status(fx.job_events(spark, d))


@query(
    q(
        """SELECT coalesce(j.job_id, r.job_id) AS job_id,
          CAST(CASE WHEN j.job_id IS NULL THEN 200 WHEN j.error IS NOT NULL THEN 500 WHEN NOT j.done THEN 202 WHEN r.job_id IS NULL THEN 500 ELSE 200 END AS BIGINT) AS code,
          CASE WHEN j.job_id IS NULL THEN 'done' WHEN j.error IS NOT NULL THEN 'error' WHEN NOT j.done THEN 'running' WHEN r.job_id IS NULL THEN 'result missing' ELSE 'done' END AS state
        FROM jobs j FULL JOIN results r ON j.job_id = r.job_id""",
        "jobs",
        "results",
    )
)
def job_status(spark, d):
    return jobs.status(jobs.latest_status(fx.job_events(spark, d)), fx.results(spark, d))


@query(q(f"SELECT path, k AS kind FROM files, (VALUES ('uploads', 3600), ('logs', 2592000), ('results', 3600)) AS v(k, s) WHERE epoch(TIMESTAMP '{NOW}') - epoch(modificationTime) > s", "files"))
def retention_expired(spark, d):
    from functools import reduce

    files, now = fx.files(spark, d), F.lit(NOW)
    return reduce(DataFrame.union, [jobs.expired(files, now, s).select("path", F.lit(k).alias("kind")) for k, s in jobs.RETENTION.items()])


def _first_editor(text: str) -> str:
    if "the" in text:
        raise ValueError("holds 'the'")
    return text.upper()


def _second_editor(text: str) -> str:
    if "of" in text:
        raise ValueError("holds 'of'")
    return text.lower()


@query(
    q(
        """SELECT doc_id, pos, CASE WHEN NOT contains(raw, 'the') THEN 'primary' WHEN NOT contains(raw, 'of') THEN 'fallback' ELSE 'none' END AS used,
          CASE WHEN contains(raw, 'the') THEN 'ValueError: holds ' || chr(39) || 'the' || chr(39) || CASE WHEN contains(raw, 'of') THEN '; ValueError: holds ' || chr(39) || 'of' || chr(39) ELSE '' END END AS error FROM lines""",
        "lines",
    )
)
def fallback_outcome(spark, d):
    return jobs.with_fallback(fx.lines(spark, d), "raw", _first_editor, _second_editor).select("doc_id", "pos", "used", "error")


# ---- files and the whole pipeline -----------------------------------------------------------------------------


@query(q("SELECT '/in/doc' || doc_id || '.docx' AS path, count(*) FILTER (WHERE type = 'table_cell') AS n_cells FROM elements WHERE doc_id % 100 <> 99 GROUP BY doc_id", "elements"))
def scan_package_cells(spark, d):
    found = parts.scan_elements(fx.packages(spark, d)).filter("error IS NULL")
    return found.groupBy("path").agg(F.count_if(F.col("type") == "table_cell").alias("n_cells"))


@query(q("SELECT * FROM package_elements UNION ALL SELECT '/in/doc' || doc_id || '.docx', NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError: not a package: BadZipFile' FROM documents WHERE doc_id % 100 = 99", "package_elements"))
def scan_package_elements(spark, d):
    return parts.scan_elements(fx.packages(spark, d))


@query(q("SELECT '/in/doc' || doc_id || '.docx' AS path, CASE WHEN doc_id % 100 = 99 THEN 0 WHEN doc_id % 50 = 49 THEN 9 ELSE 8 END AS n_parts FROM documents"))
def scan_parts(spark, d):
    return parts.scan_parts(fx.packages(spark, d)).groupBy("path").agg(F.count("part_name").alias("n_parts"))


@query(q("SELECT '/in/doc' || doc_id || '.docx' AS path, 'word/broken.xml' AS part_name FROM documents WHERE doc_id % 50 = 49 AND doc_id % 100 <> 99"))
def check_wellformed(spark, d):
    return parts.scan_nodes(parts.scan_parts(fx.packages(spark, d)).filter("error IS NULL")).filter("kind = 'malformed'").select("path", "part_name")


@query()
def scan_package_nodes(spark, d):
    return parts.scan_nodes(parts.scan_parts(fx.packages(spark, d)).filter("error IS NULL"))


@query(q("SELECT '/in/doc' || doc_id || '.docx' AS path, 'word/settings.xml' AS missing FROM documents WHERE doc_id % 2 = 0 AND doc_id % 100 <> 99"))
def check_package_settings(spark, d):
    """Packages without the track flag, from their parts."""
    nodes = parts.scan_nodes(parts.scan_parts(fx.packages(spark, d)).filter("error IS NULL AND part_name IN ('word/settings.xml', 'word/document.xml')"))
    flag = nodes.filter(F.col("name") == package.TRACK_FLAG).select("path")
    return nodes.filter("part_name = 'word/document.xml'").select("path").distinct().join(flag, "path", "left_anti").withColumn("missing", F.lit("word/settings.xml"))


@query(q("SELECT 'doc' || doc_id || '.docx' AS name, doc_id % 100 = 99 AS broken FROM documents"))
def scan_directory(spark, d):
    """Packages written as files, and the folder read again."""
    folder = fresh_path(spark, "packages")
    parts.save_packages(fx.packages(spark, d), folder)
    found = parts.scan_parts(parts.scan_packages(spark, folder))
    return found.groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("name")).agg(F.max(F.col("error").isNotNull()).alias("broken"))


@query(q("SELECT '/in/doc' || doc_id || '.docx' AS path, true AS same FROM documents WHERE doc_id % 100 <> 99"))
def package_round_trip(spark, d):
    """Parts put together again give the same bytes."""
    packed = fx.packages(spark, d)
    again = parts.write_packages(parts.scan_parts(packed)).withColumnRenamed("content", "again")
    return packed.join(again, "path").select("path", (F.sha2("content", 256) == F.sha2("again", 256)).alias("same"))


@query(q("SELECT doc_id, pos, type, element_id, text FROM elements", "elements"))
def read_structure_json(spark, d):
    """Structures written as JSON and read again."""
    path = fresh_path(spark, "structures")
    jsonio.write_structure(fx.elements(spark, d), path)
    return jsonio.elements_of(jsonio.read_structure(spark, path, multi_line=False)).select("doc_id", "pos", "type", "element_id", "text")


@query(q("SELECT doc_id, change_no, element_id, old, new, motivation FROM changes", "changes"))
def read_changes_json(spark, d):
    path = fresh_path(spark, "changes")
    jsonio.write_changes(fx.changes(spark, d), path)
    return jsonio.read_changes(spark, path)[0].select("doc_id", "change_no", "element_id", "old", "new", "motivation")


@query(q("SELECT doc_id, chunk_id, CASE WHEN n = 0 THEN 'system' ELSE 'user' END AS role FROM (SELECT DISTINCT doc_id, chunk_id FROM (" + ORACLES["chunk_greedy"].replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ")), (VALUES (0), (1)) AS v(n)"))
def batch_messages(spark, d):
    """What a model is asked: a system and a user message per batch."""
    rows = el.paragraphs(fx.lines(spark, d)).withColumn("pos", F.col("seq"))
    chunks = batching.chunk_greedy(rows, F.length("text"), PROMPT_CHARS, BUDGET)
    return batching.messages(rows, chunks, "policy", "Part of a document:").select("doc_id", "chunk_id", F.inline("messages")).select("doc_id", "chunk_id", "role")


@query()
def review_documents(spark, d):
    """The whole review with the rule-based suggester: counts per document."""
    return review.review(fx.elements(spark, d), review.RuleSuggester(fx.LEXICON), "policy").summary


@query(
    q(
        f"""SELECT doc_id, count(*) AS n_changes, count(*) FILTER (WHERE edited) AS n_edited, count(*) FILTER (WHERE NOT edited) AS n_rejected FROM (
          SELECT doc_id, verdict IN ('exact', 'fuzzy') OR (route = 'footnote' AND verdict = 'deferred')
            OR (route = 'textbox' AND verdict = 'deferred' AND EXISTS (SELECT 1 FROM elements b WHERE b.doc_id = v.doc_id AND b.type = 'textbox' AND contains({o.norm_box("b.text")}, {o.norm_box("v.old")}))) AS edited
          FROM verdict_names v) GROUP BY doc_id""",
        "verdict_names",
        "elements",
    )
)
def review_every_change(spark, d):
    """A review of given replies: each change ends as segments or as a reject."""
    item = F.struct("element_id", "footnote_id", "old", "new", "motivation")
    replies = fx.changes(spark, d).groupBy("doc_id").agg(F.lit(0).cast("long").alias("chunk_id"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("change_no", item.alias("c")))), lambda x: x["c"])).alias("raw"))
    done = review.review(fx.elements(spark, d), suggest.TableSuggester(replies), "policy")
    edited = done.segments.select("doc_id", "change_no").distinct().groupBy("doc_id").agg(F.count("*").alias("n_edited"))
    rejected = match.unapplied(done.verdicts).groupBy("doc_id").agg(F.count("*").alias("n_rejected"))
    counts = done.verdicts.groupBy("doc_id").agg(F.count("*").alias("n_changes"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return counts.join(edited, "doc_id", "left").join(rejected, "doc_id", "left").select("doc_id", "n_changes", zero("n_edited"), zero("n_rejected"))


@query(
    q(
        """SELECT '/in/doc' || d.doc_id || '.docx' AS path, 7 AS n_styles, true AS tracks, true AS compat, true AS updates, 5 AS n_rels, 5 AS n_overrides, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_refs,
          CASE WHEN n < 20 THEN 50 WHEN n < 100 THEN 100 ELSE 200 END AS n_rsids
        FROM documents d JOIN (SELECT doc_id, sum(CASE WHEN contains(raw, ' | ') THEN len(string_split(raw, ' | ')) ELSE 1 END) + 2 AS n FROM lines GROUP BY doc_id) p ON p.doc_id = d.doc_id WHERE d.doc_id % 100 <> 99""",
        "lines",
    )
)
def repair_packages(spark, d):
    """What repaired packages hold."""
    fixed = package_xml.repair_packages(fx.packages(spark, d)).filter("error IS NULL")
    nodes = parts.scan_nodes(parts.scan_parts(fixed))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return nodes.groupBy("path").agg(n("style").alias("n_styles"), *[F.max((F.col("kind") == "setting") & F.coalesce(F.col("name") == s, F.lit(False))).alias(a) for s, a in ((package.TRACK_FLAG, "tracks"), ("compat", "compat"), ("updateFields", "updates"))], n("relationship").alias("n_rels"), n("override").alias("n_overrides"), n("comment_reference").alias("n_refs"), n("rsid").alias("n_rsids"))


def _package_review(spark, d):
    found = parts.scan_elements(fx.packages(spark, d)).filter("error IS NULL")
    elements = found.select(F.regexp_extract("path", r"doc(\d+)", 1).cast("long").alias("doc_id"), F.col("seq").alias("pos"), "type", "element_id", "footnote_id", "text", "empty")
    # packages are opened and parsed once: the review reads their elements several times
    path = fresh_path(spark, "elements")
    elements.write.option("compression", "zstd").parquet(path)
    return review.review(spark.read.schema(elements.schema).parquet(path), review.RuleSuggester(fx.LEXICON), "policy")


@query(
    q(
        f"""SELECT '/in/doc' || doc_id || '.docx' AS path, count({o.FIRST_WORD}) AS n_applied, 0 AS n_failed FROM (
          SELECT doc_id, {o.strip('raw')} AS text FROM lines WHERE NOT contains(raw, ' | ')
          UNION ALL SELECT doc_id, {o.strip('cell')} FROM cells_raw
          UNION ALL SELECT doc_id, source FROM documents
          UNION ALL SELECT doc_id, lang FROM documents
          UNION ALL SELECT doc_id, 'note of ' || lang FROM documents) WHERE doc_id % 100 <> 99 GROUP BY doc_id""",
        "lines",
        "cells_raw",
    )
)
def edit_packages(spark, d):
    """Packages reviewed, elements of all kinds, and written back with tracked changes."""
    edits = review.package_edits(_package_review(spark, d), F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), F.lit(".docx")))
    edited = package_xml.edit_packages(fx.packages(spark, d), edits, "tracked").filter("error IS NULL")
    return edited.select("path", F.size("applied").cast("long").alias("n_applied"), F.size("failed").cast("long").alias("n_failed"))


@query(q("SELECT doc_id, CASE WHEN e > 0 THEN " + _UNMARK("text[1 : s - 1]") + " || chr(10) || chr(10) || " + o.strip("text[s + 23 : e - 1]") + " || chr(10) || chr(10) || " + _UNMARK("text[e + 21 :]") + " END AS prompt FROM (SELECT *, instr(text, '<!-- START_EDITABLE -->') AS s, instr(text, '<!-- END_EDITABLE -->') AS e FROM policies)", "policies"))
def prompt_assembly(spark, d):
    """The whole prompt of each valid policy."""
    p = policy.sections(fx.policies(spark, d))
    return p.select("doc_id", F.when(F.col("valid"), policy.assemble(F.col("locked_before"), F.col("editable"), F.col("locked_after"))).alias("prompt"))


@query(q("SELECT path, 'results/' || event_id || '.result' || ['.docx', '.pdf', '.txt', '', '.docx'][event_id % 5 + 1] AS result FROM files", "files"))
def result_paths(spark, d):
    number = F.regexp_extract("path", "file([0-9]+)", 1)
    return fx.files(spark, d).select("path", jobs.result_path(number, F.col("path")).alias("result"))


@query(q("SELECT doc_id, target, rid, false AS added FROM rels UNION ALL SELECT doc_id, 'theme/theme1.xml', 'rIdTheme', true FROM source_parts WHERE part_name = 'word/theme/theme1.xml'", "rels", "source_parts"))
def theme_relationship(spark, d):
    required = package.theme_relationship(fx.source_parts(spark, d)).select("doc_id", "target", "rid")
    return package.add_if_absent(fx.rels(spark, d), required, ["doc_id", "target"])


@query(q("SELECT 'job' AS kind, v.doc_id, CASE WHEN old IS NULL THEN 'missing_old' WHEN text IS NULL THEN 'unknown_element' WHEN route = 'unsupported' THEN 'unsupported' WHEN route IN ('footnote', 'textbox') THEN 'deferred' ELSE 'exact' END AS verdict, count(*) AS n FROM verdict_rows v WHERE old IS NULL OR text IS NULL OR route IN ('unsupported', 'footnote', 'textbox') OR is_exact GROUP BY ALL", "verdict_rows"))
def session_audit(spark, d):
    """Counts of the verdicts that need no similarity, per job and document."""
    v = match.verdicts(fx.changes(spark, d), fx.elements(spark, d))
    owners = fx.doc_ids(spark, d).withColumn("job_id", F.lit("job"))
    return jobs.audit(owners, v, F.lit(NOW)).filter(F.col("verdict").isin("missing_old", "unknown_element", "unsupported", "deferred", "exact")).select(F.col("job_id").alias("kind"), "doc_id", "verdict", "n")


@query()
def sql_functions(spark, d):
    """Similarity and word diff from SQL text."""
    register.register(spark)
    rows = fx.changes(spark, d).filter("old IS NOT NULL")
    return spark.sql("SELECT c.doc_id, c.change_no, similarity(c.old, c.new) AS score, s.ord, s.kind, s.val FROM {c} c, LATERAL diff_words(c.old, c.new) s", c=rows)


@query(q("SELECT 'doc' || doc_id || '.docx' AS name, CASE WHEN doc_id % 100 = 99 THEN 0 WHEN doc_id % 50 = 49 THEN 9 ELSE 8 END AS n_parts FROM documents"))
def office_parts(spark, d):
    """Packages through the data source."""
    folder = fresh_path(spark, "packages")
    parts.save_packages(fx.packages(spark, d), folder)
    datasource.register(spark)
    rows = spark.read.format("office_parts").load(folder)
    return rows.groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("name")).agg(F.count("part_name").alias("n_parts"))
