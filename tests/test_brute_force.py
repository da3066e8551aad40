"""Whole results of the queries without SQL against plain loops over the same fixtures."""

import difflib
import re

import numpy as np
import pytest

from quillmill.plans import fixtures as fx
from quillmill.plans import queries as q

SF = "/root/testdata/sf0.001"


def norm(x):
    return " ".join(x.split())


def lcs(a, b):
    row = np.zeros(len(b) + 1, dtype=int)
    codes = np.array([ord(c) for c in b])
    for c in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (codes == ord(c))))
    return int(row[-1])


def ratio(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100


def replace(text, old, new):
    if old and old in text:
        return text.replace(old, new, 1)
    hit = re.search(r"\s+".join(map(re.escape, old.split())), text) if old.split() else None
    return text[: hit.start()] + new + text[hit.end() :] if hit else new


def segments(old, new):
    kinds = {"  ": "text", "- ": "strike", "+ ": "insert"}
    lines = [x for x in difflib.ndiff(old.split(), new.split()) if x[:2] in kinds]
    return [(k, kinds[x[:2]], x[2:] + " ") for k, x in enumerate(lines)]


def guarded(old):
    return norm(old).isdigit() or len(norm(old)) < 4


@pytest.fixture(scope="module")
def changes(spark):
    return [r.asDict() for r in fx.changes(spark, SF).collect()]


@pytest.fixture(scope="module")
def elements(spark):
    return {(r["doc_id"], r["element_id"]): r["text"] for r in fx.elements(spark, SF).collect()}


@pytest.fixture(scope="module")
def verdicts(changes, elements):
    out = {}
    for c in changes:
        e, old, text = c["element_id"] or "", c["old"], elements.get((c["doc_id"], c["element_id"]))
        if old is None:
            v = "missing_old"
        elif text is None:
            v = "unknown_element"
        elif e.startswith(("footnote_", "textbox_")):
            v = "deferred"
        elif not e.startswith(("paragraph_", "header_", "footer_", "table_")):
            v = "unsupported"
        elif norm(old) in norm(text):
            v = "exact"
        elif e.startswith("table_") and guarded(old):
            v = "too_short"
        else:
            v = "fuzzy" if 200 * min(len(norm(old)), len(norm(text))) >= 89 * len(norm(old) + norm(text)) and ratio(norm(old), norm(text)) >= 90 else "no_match"
        out[c["doc_id"], c["change_no"]] = (v, c, text)
    return out


@pytest.fixture(scope="module")
def cells(spark):
    """Cell changes with the paragraph that they match: (change, paragraph number, paragraphs, how)."""
    paragraphs = {}
    for r in fx.cell_paragraphs(spark, SF).collect():
        paragraphs.setdefault((r["doc_id"], r["element_id"]), {})[r["par_no"]] = r["text"]
    out = []
    for c in fx.cell_changes(spark, SF).collect():
        mine = paragraphs[c["doc_id"], c["element_id"]]
        first = next((k for k in sorted(mine) if norm(c["old"]) in norm(mine[k])), None)
        whole = norm("\n".join(mine[k] for k in sorted(mine)))
        if first is not None:
            out.append((c, first, mine, "exact"))
        elif not guarded(c["old"]) and ratio(norm(c["old"]), whole) >= 90:
            out.append((c, 0, mine, "fuzzy"))
    return out


def same(df, columns, want):
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))
    assert want


def test_verdicts(spark, verdicts):
    same(q.match_verdicts(spark, SF), ["doc_id", "change_no", "verdict"], [(*k, v[0]) for k, v in verdicts.items()])


def test_word_diff_and_sql_functions(spark, changes):
    rows = [(c["doc_id"], c["change_no"], *s, ratio(c["old"], c["new"])) for c in changes if c["old"] is not None for s in segments(c["old"], c["new"] or "")]
    same(q.word_diff(spark, SF), ["doc_id", "change_no", "ord", "kind", "val"], [r[:-1] for r in rows])
    same(q.sql_functions(spark, SF), ["doc_id", "change_no", "ord", "kind", "val", "score"], rows)


def test_diff_paragraph(spark, verdicts):
    want = []
    for k, (v, c, text) in verdicts.items():
        if v in ("exact", "fuzzy") and not c["element_id"].startswith("table_"):
            want += [(*k, *s) for s in segments(text, replace(text, c["old"], c["new"] or ""))]
    same(q.diff_paragraph(spark, SF), ["doc_id", "change_no", "ord", "kind", "val"], want)


def test_cells(spark, cells):
    same(q.match_cells(spark, SF), ["doc_id", "change_no", "element_id", "par_no", "how"], [(c["doc_id"], c["change_no"], c["element_id"], k, how) for c, k, _, how in cells])
    want = [(c["doc_id"], c["change_no"], k, *s) for c, k, _, _ in cells for s in segments(c["old"], c["new"])]
    same(q.diff_cell(spark, SF), ["doc_id", "change_no", "par_no", "ord", "kind", "val"], want)
    want = [(c["doc_id"], c["change_no"], k, *s) for c, k, mine, _ in cells for s in segments(mine[k], replace(mine[k], c["old"], c["new"]))]
    same(q.diff_cell_paragraph(spark, SF), ["doc_id", "change_no", "par_no", "ord", "kind", "val"], want)


def test_text_boxes(spark, changes, elements):
    bare = lambda x: "".join((x or "").split()).replace("–", "-").replace("—", "-")
    found = []
    for c in changes:
        if (c["element_id"] or "").startswith("textbox_"):
            boxes = sorted(((int(e.split("_")[1]), e, t) for (d, e), t in elements.items() if d == c["doc_id"] and e.startswith("textbox_")))
            hit = next(((e, t) for _, e, t in boxes if bare(c["old"]) in bare(t)), None)
            found += [(c, *hit)] if hit else []
    same(q.diff_textbox(spark, SF), ["doc_id", "change_no", "box_id", "ord", "kind", "val"], [(c["doc_id"], c["change_no"], e, *s) for c, e, _ in found for s in segments(c["old"], c["new"])])
    same(q.diff_textbox_full(spark, SF), ["doc_id", "change_no", "box_id", "ord", "kind", "val"], [(c["doc_id"], c["change_no"], e, *s) for c, e, t in found for s in segments(t, replace(t, c["old"], c["new"]))])


def test_package_nodes(spark):
    """Per package: its relationship, override, style, settings, comment, references and paragraphs; a malformed part for every fiftieth."""
    texts = {r["doc_id"]: r["text"] for r in fx.docs(spark, SF).collect()}
    want = []
    for i, text in texts.items():
        if i % 100 == 99:
            continue
        lines = text.split("\n")
        rows = [x for x in lines if " | " in x]
        # paragraphs, cells, the one with the drawing and the one in it
        n = len(lines) - len(rows) + sum(len(x.split(" | ")) for x in rows) + 2
        own = [("word/_rels/document.xml.rels", "relationship", "header1.xml"), ("[Content_Types].xml", "override", "main"), ("word/styles.xml", "style", "paragraph"), ("word/comments.xml", "comment", "c"), ("word/document.xml", "comment_reference", None), ("word/document.xml", "paragraphs", str(n))]
        own += [("word/settings.xml", "setting", None)] * (i % 2) + [("word/broken.xml", "malformed", None)] * (i % 50 == 49)
        want += [(f"/in/doc{i}.docx", *x) for x in own]
    same(q.scan_package_nodes(spark, SF), ["path", "part_name", "kind", "value"], want)


def test_review_counts(spark, elements):
    """Every element with a word of the lexicon gets one change; all of them are found in their element."""
    counts = {}
    for (d, e), text in elements.items():
        if any(w in fx.LEXICON for w in text.split()):
            counts[d] = counts.get(d, 0) + 1
    same(q.review_documents(spark, SF), ["doc_id", "n_changes", "n_exact", "n_unapplied"], [(d, n, n, 0) for d, n in counts.items()])


def test_page_notes(spark):
    """Lines from the top, exact line, near line or page search, then the greedy removal of repeats."""
    clean = lambda x: re.sub(r"([a-zA-Z])[0-9]{1,3}\b", r"\1", x).strip()
    holds = lambda text, old: norm(old) in norm(clean(text)) or norm(clean(text)) in norm(clean(old))
    pages, last = {}, {}
    for b in fx.blocks(spark, SF).collect():
        pages.setdefault((b["doc_id"], b["page"]), []).append(b)
        last[b["doc_id"]] = max(last.get(b["doc_id"], 0), b["page"])
    lines = {k: [(n, b) for n, b in enumerate(sorted(v, key=lambda b: (b["y0"], b["ord"])), 1) if b["text"].strip()] for k, v in pages.items()}
    notes = {}
    for c in sorted(fx.pdf_changes(spark, SF).collect(), key=lambda c: (c["doc_id"], c["change_no"])):
        if c["old"] is None or c["page"] is None or not 1 <= c["page"] <= last[c["doc_id"]]:
            continue
        mine = lines[c["doc_id"], c["page"]]
        if c["line"]:
            hits = [(n, b) for n, b in mine if n == c["line"] and holds(b["text"].strip(), c["old"])] or [(n, b) for n, b in mine if abs(n - c["line"]) <= 2 and holds(b["text"].strip(), c["old"])][:1]
        else:
            hits = [(n, b) for n, b in mine if c["old"] and c["old"].lower() in b["text"].lower()]
        content = f"Förslag: {c['new']} \n\nMotivering: {c['motivation'] or ''}" if c["new"] else None
        for _, b in hits:
            kept = notes.setdefault((c["doc_id"], c["page"]), [])
            if not any((content or "").strip() == (t or "").strip() or all(abs(x - y) < 5 for x, y in zip(xs, (b["x0"], b["y0"], b["x1"], b["y1"]))) for _, xs, t in kept):
                kept.append((c["change_no"], (b["x0"], b["y0"], b["x1"], b["y1"]), content))
    want = [(*k, n, xs[1], t) for k, v in notes.items() for n, xs, t in v]
    same(q.page_notes(spark, SF), ["doc_id", "page", "change_no", "y0", "content"], want)
