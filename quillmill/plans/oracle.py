"""SQL twins of the fixtures and of the queries, for DuckDB."""

from __future__ import annotations

from ..operators import package
from . import fixtures as fx

WS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def clean_pdf(x: str) -> str:
    return strip(rf"regexp_replace({x}, '([a-zA-Z])[0-9]{{1,3}}\b', '\1', 'g')")


def split_words(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({norm(x)}, ' ') END"


def norm_box(x: str) -> str:
    return f"replace(replace(regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g'), '–', '-'), '—', '-')"


def literal(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(literal(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") AS v({columns})"


def _kept(items, name: str, modulus: int) -> str:
    return f"SELECT doc_id, v.{name} FROM documents, {values([(k, x) for k, x in enumerate(items)], f'k, {name}')} WHERE (doc_id + v.k) % {modulus} <> 0"


LEX = ", ".join(literal(w) for w in fx.LEXICON)
FIRST_WORD = f"list_filter({split_words('text')}, lambda w: w IN ({LEX}))[1]"
REPLACED = "CASE w " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in fx.LEXICON.items()) + " END"
PLANTED = [(1, "paragraph_99999", None, "the", "a", "unknown"), (3, None, None, "the", "a", None), (4, "header_1", None, "src", "source", "names"), (5, "footnote_1", "1", "x", "a new note", "notes"), (6, "textbox_1", None, "the", "a box", None), (7, "table_1_cell_1_1", None, "zz", "y", "cells"), (8, "comment_1", None, "the", "a", "kinds"), (9, "paragraph_1", None, None, "a", "no old"), (11, "paragraph_1", None, "12", "13", "")]
KEEP = "CAST({} AS BIGINT)"

#: Common table expressions: name -> (names that it needs, SQL).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents"),
    "cells_raw": (("lines",), "SELECT doc_id, r, CAST(generate_subscripts(string_split(raw, ' | '), 1) AS BIGINT) AS c, unnest(string_split(raw, ' | ')) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM lines WHERE contains(raw, ' | '))"),
    "boxes": (("lines",), "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE pos % 9 = 0"),
    "notes": (("lines",), "SELECT *, CAST(CAST(floor(pos / 10) AS BIGINT) - 2 AS VARCHAR) AS note_id FROM lines WHERE pos % 10 = 0"),
    "notes_kept": (("notes",), f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM notes WHERE note_id NOT IN ('-1', '0') AND {strip('raw')} <> ''"),
    "elements": (
        ("lines", "cells_raw", "boxes", "notes_kept"),
        f"""SELECT doc_id, seq, type, element_id, footnote_id, {strip("raw")} AS text, {strip("raw")} = '' AS empty,
          row_number() OVER (PARTITION BY doc_id ORDER BY kind_rank, seq) AS pos
        FROM (
          SELECT doc_id, 1 AS kind_rank, pos AS seq, 'paragraph' AS type, 'paragraph_' || pos AS element_id, CAST(NULL AS VARCHAR) AS footnote_id, raw FROM lines
          UNION ALL SELECT doc_id, 2, r * 10000 + c - 1, 'table_cell', 'table_1_cell_' || r || '_' || c, NULL, cell FROM cells_raw
          UNION ALL SELECT doc_id, 3, 1, 'header', 'header_1', NULL, source FROM documents
          UNION ALL SELECT doc_id, 4, 1, 'footer', 'footer_1', NULL, lang FROM documents
          UNION ALL SELECT doc_id, 5, n, 'textbox', 'textbox_' || n, NULL, raw FROM boxes
          UNION ALL SELECT doc_id, 6, n, 'footnote', 'footnote_' || n, note_id, raw FROM notes_kept)""",
    ),
    "paragraphs": (("elements",), "SELECT * FROM elements WHERE type = 'paragraph'"),
    "cells": (("elements",), "SELECT * FROM elements WHERE type = 'table_cell'"),
    "changes": (
        ("paragraphs",),
        f"""SELECT doc_id, seq AS change_no, element_id, CAST(NULL AS VARCHAR) AS footnote_id,
            CASE WHEN seq % 3 = 1 THEN w WHEN seq % 3 = 2 THEN n[:-2] || '#' ELSE 'zzzz ' || w END AS old,
            CASE WHEN seq % 3 = 2 THEN 'rewritten' ELSE {REPLACED} END AS new,
            CASE WHEN seq % 2 = 1 THEN 'plain language' END AS motivation
          FROM (SELECT *, {FIRST_WORD} AS w, {norm("text")} AS n FROM paragraphs) WHERE w IS NOT NULL
          UNION ALL
          SELECT doc_id, 1000000 + v.k, v.element_id, v.footnote_id, v.old, v.new, v.motivation
          FROM documents, {values([(k, *p) for k, p in enumerate(PLANTED)], "k, m, element_id, footnote_id, old, new, motivation")} WHERE doc_id % v.m = 0""",
    ),
    "blocks": (("lines",), "SELECT doc_id, CAST(floor((pos - 1) / 20) AS BIGINT) + 1 AS page, pos AS ord, 50.0::DOUBLE AS x0, CAST((pos - 1) % 20 * 10 AS DOUBLE) AS y0, 500.0::DOUBLE AS x1, CAST((pos - 1) % 20 * 10 + 9 AS DOUBLE) AS y1, CASE WHEN pos % 13 = 0 THEN '  ' ELSE raw END AS text FROM lines"),
    "pdf_lines": (("blocks",), f"SELECT doc_id, page, line, {strip('text')} AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, ord) AS line FROM blocks) WHERE {strip('text')} <> ''"),
    "page_counts": (("blocks",), "SELECT doc_id, max(page) AS n_pages FROM blocks GROUP BY doc_id"),
    "pdf_changes": (
        ("lines",),
        f"""SELECT doc_id, pos AS change_no,
            CASE WHEN pos % 5 = 1 THEN NULL WHEN pos % 7 = 1 THEN 0 WHEN pos % 9 = 1 THEN 999 ELSE CAST(floor((pos - 1) / 20) AS BIGINT) + 1 END AS page,
            CASE WHEN pos % 3 <> 1 THEN (pos - 1) % 20 + 1 + CAST(floor(pos / 6) AS BIGINT) % 4 END AS line,
            CASE WHEN pos % 11 <> 1 THEN array_to_string(words[1:3], ' ') END AS old,
            CASE WHEN pos % 2 = 1 THEN 'rewrite ' || pos ELSE '' END AS new,
            CASE WHEN pos % 4 = 1 THEN 'why' END AS motivation
          FROM (SELECT *, {split_words("raw")} AS words FROM lines) WHERE len(words) >= 3""",
    ),
    "pdf_valid": (("pdf_changes", "page_counts"), "SELECT c.* FROM pdf_changes c JOIN page_counts p ON c.doc_id = p.doc_id WHERE c.page IS NOT NULL AND c.old IS NOT NULL AND c.page BETWEEN 1 AND p.n_pages"),
    "pdf_exact": (("pdf_valid", "pdf_lines"), f"SELECT c.doc_id, c.change_no, c.page, c.line, l.text FROM pdf_valid c JOIN pdf_lines l ON c.doc_id = l.doc_id AND c.page = l.page AND c.line = l.line WHERE c.line <> 0 AND (contains({norm(clean_pdf('l.text'))}, {norm('c.old')}) OR contains({norm(clean_pdf('c.old'))}, {norm(clean_pdf('l.text'))}))"),
    "annotations": (("blocks",), "SELECT doc_id, page, ord, CAST(50 + (ord % 3) * 4.9 AS DOUBLE) AS x0, floor(ord / 2) * 5.0::DOUBLE AS y0, CAST(50 + (ord % 3) * 4.9 AS DOUBLE) + 100 AS x1, floor(ord / 2) * 5.0::DOUBLE + 9 AS y1, CASE WHEN ord % 7 = 0 THEN 'same' ELSE ' note ' || ord END AS content FROM blocks"),
    "runs": (
        ("lines",),
        f"""SELECT doc_id, CASE WHEN para_no % 11 = 0 THEN 'word/footnotes.xml' ELSE 'word/document.xml' END AS part_name, para_no, run_no,
            CASE WHEN (para_no + run_no) % 7 IN (0, 2) THEN 'FF0000' WHEN (para_no + run_no) % 7 = 1 THEN '008000' END AS color,
            CASE WHEN (para_no + run_no) % 7 = 0 THEN true WHEN (para_no + run_no) % 7 = 2 THEN false END AS strike, text,
            CASE WHEN run_no % 5 = 0 THEN CAST(run_no AS VARCHAR) END AS comment_ref, CASE WHEN run_no % 6 = 5 THEN 'f' || run_no END AS footnote_ref
          FROM (SELECT doc_id, pos AS para_no, CAST(generate_subscripts(words, 1) AS BIGINT) - 1 AS run_no, unnest(words) AS text FROM (SELECT *, ({split_words("raw")}) AS words FROM lines))""",
    ),
    "replies": (
        (),
        r"""SELECT conv_id AS doc_id, turn AS chunk_id, conv_id % 10 <> 9 AS ok,
            CASE turn % 7 WHEN 0 THEN '```json' || chr(10) || arr || chr(10) || '```' WHEN 1 THEN arr WHEN 2 THEN clean WHEN 3 THEN item1 WHEN 4 THEN ' [] ' WHEN 5 THEN '[{"element_id": "paragraph_1", "page": "seven", "old": "' || clean[:20] || '", "new": "x"}]' ELSE '```' || chr(10) || arr || '```' END AS raw
          FROM (SELECT *, '{"element_id": "paragraph_1", "page": 1, "old": "' || clean[:20] || '", "new": "x"}' AS item1,
              '[{"element_id": "paragraph_1", "page": 1, "old": "' || clean[:20] || '", "new": "x"}, {"element_id": "paragraph_1", "page": 2, "old": "' || clean[:20] || '", "new": "x"}]' AS arr
            FROM (SELECT *, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS clean FROM conversations))""",
    ),
    "cleaned": (
        ("replies",),
        f"""SELECT *, {strip("CASE WHEN starts_with(s, '```') THEN regexp_replace(" + strip("regexp_replace(s, '^```(json)?', '')") + ", '```$', '') ELSE raw END")} AS cleaned
          FROM (SELECT *, {strip("raw")} AS s FROM replies)""",
    ),
    "styles": ((), _kept(fx.STYLE_IDS, "style_id", 5)),
    "style_names": ((), "SELECT * FROM " + values(package.STYLE_NAMES.items(), "style_id, name")),
    "named_styles": (("styles", "style_names"), "SELECT s.doc_id, s.style_id, coalesce(n.name, s.style_id) AS name FROM styles s LEFT JOIN style_names n ON s.style_id = n.style_id"),
    "parts": ((), f"SELECT *, 'target:' || doc_id || ':' || part_name AS content FROM ({_kept(fx.PART_NAMES, 'part_name', 9)})"),
    "source_parts": ((), f"SELECT *, 'source:' || doc_id || ':' || part_name AS content FROM ({_kept((*package.MERGED_PARTS, 'customXml/item1.xml', 'word/other.xml'), 'part_name', 4)})"),
    "rels": ((), f"SELECT doc_id, v.target, 'rId' || (v.k + 1 + doc_id % 2) AS rid FROM documents, {values([(k, t) for k, t in enumerate(fx.TARGETS)], 'k, target')} WHERE (doc_id + v.k) % 6 <> 0"),
    "settings": ((), _kept(fx.SETTINGS, "name", 3)),
    "overrides": ((), f"SELECT *, 'present' AS content_type FROM ({_kept(tuple(p for p, _ in package.COMMENT_OVERRIDES) + ('/word/document.xml',), 'part_name', 2)})"),
    "required_styles": ((), "SELECT d.doc_id, v.style FROM documents d, " + values([(s,) for s in package.REQUIRED_STYLES], "style")),
    "required_targets": ((), "SELECT d.doc_id, v.target FROM documents d, " + values([(s,) for s in package.REQUIRED_TARGETS], "target")),
    "missing_styles": (("required_styles", "named_styles"), "SELECT r.doc_id, r.style FROM required_styles r WHERE NOT EXISTS (SELECT 1 FROM named_styles n WHERE n.doc_id = r.doc_id AND n.name = r.style)"),
    "missing_targets": (("required_targets", "rels"), "SELECT r.doc_id, r.target FROM required_targets r WHERE NOT EXISTS (SELECT 1 FROM rels x WHERE x.doc_id = r.doc_id AND contains(x.target, r.target))"),
    "comments": ((), "SELECT doc_id % 50 AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'c' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS comment_id, 'text' AS text FROM labels"),
    "comment_refs": ((), "SELECT doc_id % 50 AS doc_id, CAST(doc_id AS VARCHAR) AS comment_id FROM documents"),
    "orphans": (("comments", "comment_refs"), "SELECT r.* FROM comment_refs r WHERE NOT EXISTS (SELECT 1 FROM comments c WHERE c.doc_id = r.doc_id AND c.comment_id = r.comment_id)"),
    "rsids": (("lines",), "SELECT doc_id, CAST(pos % 15 AS VARCHAR) AS rsid FROM lines"),
    "nodes": (
        ("runs",),
        """SELECT doc_id, n * 10 + k AS node, CASE WHEN k = 0 THEN -1 ELSE n * 10 END AS parent,
            CASE k WHEN 0 THEN 'rPr' WHEN 1 THEN CASE WHEN n % 2 = 0 THEN 'noProof' ELSE 'b' END ELSE CASE WHEN n % 4 = 0 THEN 'proofErr' ELSE 'i' END END AS tag,
            CASE WHEN k = 0 THEN CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n_children
          FROM (SELECT doc_id, para_no * 1000000 + run_no AS n FROM runs), (VALUES (0), (1), (2)) AS v(k) WHERE k <= CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END""",
    ),
    "job_events": ((), "SELECT user_id AS job_id, event_id AS seq, event_type AS status, event_type IN ('purchase', 'signup') AS done, CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error FROM events"),
    "jobs": (("job_events",), "SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1"),
    "results": ((), "SELECT DISTINCT user_id AS job_id FROM events WHERE user_id % 3 = 0 UNION SELECT event_id + 10000000 FROM events WHERE event_id % 100 = 0"),
    "files": ((), "SELECT '/up.d/file' || event_id || ['.docx', '.PDF', '.txt', '', '.Docx'][event_id % 5 + 1] AS path, ts AS modificationTime, event_id FROM events"),
    "policies": (("lines",), "SELECT doc_id, '<!-- START_LOCKED -->' || chr(10) || chr(10) || 'Before ' || doc_id || chr(10) || '<!-- END_LOCKED -->' || chr(10) || chr(10) || '<!-- START_EDITABLE -->' || chr(10) || ' ' || raw || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '<!-- END_EDITABLE -->' END || chr(10) || '<!-- START_LOCKED -->' || chr(10) || 'After' || chr(10) || '<!-- END_LOCKED -->' || chr(10) AS text FROM lines WHERE pos = 1"),
    "segments": (("runs",), "SELECT doc_id, para_no AS change_no, run_no AS ord, CASE (para_no + run_no) % 5 WHEN 3 THEN 'strike' WHEN 4 THEN 'insert' ELSE 'text' END AS kind, text || ' ' AS val FROM runs"),
    "refs": (("lines",), "SELECT doc_id, pos AS change_no, v.ref_id, v.off FROM lines, (VALUES ('f1', 10), ('f2', 45)) AS v(ref_id, off)"),
    "verdict_rows": (
        ("changes", "elements"),
        f"""SELECT c.doc_id, c.change_no, c.element_id, c.old, c.new, c.motivation, e.text,
            CASE WHEN regexp_matches(coalesce(c.element_id, ''), '^(paragraph|header|footer)_') THEN 'paragraph'
              WHEN starts_with(c.element_id, 'table_') AND contains(c.element_id, '_cell_') THEN 'table_cell'
              WHEN starts_with(c.element_id, 'footnote_') THEN 'footnote' WHEN starts_with(c.element_id, 'textbox_') THEN 'textbox' ELSE 'unsupported' END AS route,
            contains({norm("e.text")}, {norm("c.old")}) AS is_exact
          FROM changes c LEFT JOIN elements e ON c.doc_id = e.doc_id AND c.element_id = e.element_id""",
    ),
}

# Verdicts of the fixture's changes, similarity included: the nearly equal old texts differ from their paragraph in one
# letter, which is 90 of 100 from ten letters on; none of the other old texts comes near that.
SQL["verdict_names"] = (
    ("verdict_rows",),
    f"""SELECT *, CASE WHEN old IS NULL THEN 'missing_old' WHEN text IS NULL THEN 'unknown_element' WHEN route = 'unsupported' THEN 'unsupported'
          WHEN route IN ('footnote', 'textbox') THEN 'deferred' WHEN is_exact THEN 'exact'
          WHEN route = 'table_cell' AND (regexp_matches({norm("old")}, '^[0-9]+$') OR length({norm("old")}) < 4) THEN 'too_short'
          WHEN change_no < 1000000 AND change_no % 3 = 2 AND length({norm("text")}) >= 10 THEN 'fuzzy' ELSE 'no_match' END AS verdict
        FROM verdict_rows""",
)
# Elements as packages give them: paragraphs without table rows, one drawing with its own paragraph, one header, one note.
SQL["package_elements"] = (
    ("lines", "cells_raw"),
    f"""SELECT '/in/doc' || doc_id || '.docx' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY k, r, c) AS seq, type, element_id, footnote_id, text, text = '' AS empty, CAST(NULL AS VARCHAR) AS error
        FROM (
          SELECT doc_id, 1 AS k, n AS r, 0 AS c, 'paragraph' AS type, 'paragraph_' || n AS element_id, CAST(NULL AS VARCHAR) AS footnote_id, {strip("raw")} AS text
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE NOT contains(raw, ' | '))
          UNION ALL SELECT doc_id, 1, 1 + (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id AND NOT contains(l.raw, ' | ')), 0, 'paragraph', 'paragraph_' || (1 + (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id AND NOT contains(l.raw, ' | '))), NULL, '' FROM documents d
          UNION ALL SELECT doc_id, 2, r, c, 'table_cell', 'table_1_cell_' || r || '_' || c, NULL, {strip("cell")} FROM cells_raw
          UNION ALL SELECT doc_id, 3, 1, 0, 'header', 'header_1', NULL, source FROM documents
          UNION ALL SELECT doc_id, 4, 1, 0, 'textbox', 'textbox_1', NULL, lang FROM documents
          UNION ALL SELECT doc_id, 5, 1, 0, 'footnote', 'footnote_1', '7', 'note of ' || lang FROM documents) WHERE doc_id % 100 <> 99""",
)


def q(body: str, *needs: str) -> str:
    """``body`` after the common table expressions that it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in SQL[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in order) + "\n" if order else "") + body
