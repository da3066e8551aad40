"""Edits and repairs of whole packages: parts in, parts out.

A package is one row and small, so these are functions over its parts, run
batch by batch in Python workers; which edits a package gets is decided before,
on tables.
"""

from __future__ import annotations

import copy
import hashlib
import io
import re
from collections.abc import Callable
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import in_turn, ndiff_words
from ..sources.parts import FRAME_CHARS, MAX_BYTES, SMALL_PART, W, elements_of, pack, paragraph_text, parse_xml, unpack
from .match import THRESHOLD
from .package import COMMENT_OVERRIDES, COMMENT_RELATIONSHIPS, REMOVED_TAGS, THEME
from .tracked import ENDINGS, GREEN, RED

RELS_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES_NS = "http://schemas.openxmlformats.org/package/2006/content-types"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
DOCUMENT, RELS, TYPES, STYLES, SETTINGS, COMMENTS, NOTES = "word/document.xml", "word/_rels/document.xml.rels", "[Content_Types].xml", "word/styles.xml", "word/settings.xml", "word/comments.xml", "word/footnotes.xml"
COMMENTS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
COMMENTS_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
#: Required styles as (id, type, name, default).
STYLE_DEFINITIONS = (
    ("Normal", "paragraph", "Normal", True),
    ("DefaultParagraphFont", "character", "Default Paragraph Font", False),
    ("TableNormal", "table", "Table Normal", False),
    ("CommentText", "character", "Comment Text", False),
    ("InsertedText", "character", "Inserted Text", False),
    ("DeletedText", "character", "Deleted Text", False),
)
BASED_ON_FONT = ("CommentText", "InsertedText", "DeletedText")
#: Minimal contents of parts for comments.
EMPTY_PARTS = {
    COMMENTS: '<w:comments xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"/>',
    "word/commentsExtended.xml": '<w15:commentsEx xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"/>',
    "word/commentsIds.xml": '<w16cid:commentsIds xmlns:w16cid="http://schemas.microsoft.com/office/word/2016/wordml/cid"/>',
    "word/people.xml": '<w15:people xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"/>',
}
#: Prefixes that ElementTree knows by itself.
PREFIXES = {
    "http://www.w3.org/XML/1998/namespace": "xml",
    "http://www.w3.org/1999/xhtml": "html",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://schemas.xmlsoap.org/wsdl/": "wsdl",
    "http://www.w3.org/2001/XMLSchema": "xs",
    "http://www.w3.org/2001/XMLSchema-instance": "xsi",
    "http://purl.org/dc/elements/1.1/": "dc",
}
#: Tag of an element that is not parsed or built but written by a function; no part has it.
WRITTEN = "written"
#: The first tag of a part in an encoding that ASCII is part of, and the prefixes that it declares.
ROOT_TAG = re.compile(rb"""\s*(?:<\?xml(?:(?!\?>|encoding)[^>])*(?:encoding=["']utf-8["'](?:(?!\?>)[^>])*)?\?>\s*)?<[A-Za-z_][^<>]*>""", re.I)
DECLARED = re.compile(rb"""\sxmlns(?::([^\s=]+))?\s*=\s*(?:"([^"]*)"|'([^']*)')""")
#: What XML can't hold.
ILLEGAL = re.compile("[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
#: Elements whose runs stay when their paragraph is rebuilt.
REFERENCES = {f"{W}{t}" for t in ("footnoteReference", "footnoteRef", "commentReference", "drawing")}
#: Revision ids for documents of fewer paragraphs than these, and for larger ones.
RSID_BUCKETS, MOST_RSIDS = ((20, 50), (100, 100)), 200


#: What has been worked out for small parts, KEPT of them at most: packages share them. A plain table, as functions go to the workers by value.
_kept: dict = {}
KEPT = 1024


def _once(key: tuple, make: Callable):
    """``make()``, kept by the key if the part in it is small."""
    found = _kept.get(key)
    if found is None:
        found = make()
        if len(_kept) < KEPT and len(key[1]) <= SMALL_PART:
            _kept[key] = found
    return found


def load(content: bytes) -> tuple[ET.Element, dict[str, str]]:
    """The root of a part and the prefixes that it declares."""
    if len(content) > SMALL_PART // 4:
        return _load(content)
    root, prefixes = _once(("load", content), lambda: _load(content))
    return copy.deepcopy(root), dict(prefixes)


def _load(content: bytes) -> tuple[ET.Element, dict[str, str]]:
    root = parse_xml(content)
    first = ROOT_TAG.match(content)
    if first and b"&" not in first[0] and first[0].count(b"xmlns") == content.count(b"xmlns"):
        # nothing but the root declares prefixes
        return root, {p.decode(): (a or b).decode() for p, a, b in DECLARED.findall(first[0])}
    return root, dict(ns for _, ns in ET.iterparse(io.BytesIO(content), ["start-ns"]))


def dump(root: ET.Element, prefixes: dict[str, str]) -> bytes:
    """The part as bytes, with its own prefixes; those that only attribute values mention stay declared."""
    text = _written(root, prefixes)
    end = text.index(">") - (text[text.index(">") - 1] == "/")
    head = text[:end]
    lost = "".join(f' xmlns:{p}="{u}"' for p, u in sorted(prefixes.items()) if p and p != "xml" and f"xmlns:{p}=" not in head)
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + head + lost + text[end:]).encode()


def _escaped(text: str) -> str:
    if "&" in text:
        text = text.replace("&", "&amp;")
    if "<" in text:
        text = text.replace("<", "&lt;")
    return text.replace(">", "&gt;") if ">" in text else text


def _quoted(text: str) -> str:
    text = _escaped(text)
    for c, code in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        if c in text:
            text = text.replace(c, code)
    return text


def _written(root: ET.Element, prefixes: dict[str, str]) -> str:
    """The text that ElementTree writes for the tree, in one pass; a WRITTEN element's text comes from its function."""
    known = dict(PREFIXES)
    for prefix, uri in prefixes.items():
        if prefix != "xml" and not (prefix.startswith("ns") and prefix[2:].isdigit()):
            known = {u: p for u, p in known.items() if p != prefix}
            known[uri] = prefix
    used: dict[str, str] = {}
    names: dict[str, str] = {}

    def name(tag: str) -> str:
        found = names.get(tag)
        if found is None:
            found = tag
            if tag[:1] == "{":
                uri, local = tag[1:].rsplit("}", 1)
                prefix = used.get(uri)
                if prefix is None:
                    prefix = known.get(uri, f"ns{len(used)}")
                    if prefix != "xml":
                        used[uri] = prefix
                found = f"{prefix}:{local}" if prefix else local
            names[tag] = found
        return found

    out: list[str] = []

    def put(node: ET.Element) -> None:
        if node.tag == WRITTEN:
            out.append(node.get("by")(name))
            return
        tag = names.get(node.tag) or name(node.tag)
        start = "<" + tag
        for k, v in node.items():
            start += f' {names.get(k) or name(k)}="{_quoted(v)}"'
        if len(node) or node.text:
            out.append(f"{start}>{_escaped(node.text)}" if node.text else start + ">")
            for child in node:
                put(child)
            out.append(f"</{tag}>{_escaped(node.tail)}" if node.tail else f"</{tag}>")
        else:
            out.append(f"{start} />{_escaped(node.tail)}" if node.tail else start + " />")

    put(root)
    declared = "".join(f' xmlns{":" + p if p else ""}="{_quoted(u)}"' for u, p in sorted(used.items(), key=lambda x: x[1]))
    head = len(name(root.tag)) + 1
    out[0] = out[0][:head] + declared + out[0][head:]
    return "".join(out)


def _drawn_up(parent: ET.Element, by: Callable[[Callable[[str], str]], str], **attributes: str) -> None:
    """A child (with the attributes, to be looked up) whose text a function makes when the part is written, given the part's names: many short elements need not be built one by one."""
    ET.SubElement(parent, WRITTEN, {"by": by} | {f"{W}{k}": v for k, v in attributes.items()})


class Parts:
    """The parts of a package: each is parsed once, when it is needed, and written once, if it has changed."""

    def __init__(self, content: dict[str, bytes]):
        self.content, self.trees, self.changed = dict(content), {}, set()

    def __contains__(self, name: str) -> bool:
        return name in self.content

    def load(self, name: str) -> tuple[ET.Element, dict[str, str]]:
        if name not in self.trees:
            self.trees[name] = load(self.content[name])
        return self.trees[name]

    def root(self, name: str) -> ET.Element:
        return self.load(name)[0]

    def change(self, name: str, tree: tuple[ET.Element, dict[str, str]] | None = None) -> None:
        """The part's tree, or the given one, is what the part holds now."""
        if tree is not None:
            self.trees[name] = tree
        self.content.setdefault(name, b"")
        self.changed.add(name)

    def replace(self, name: str, content: bytes) -> None:
        self.content[name] = content
        self.trees.pop(name, None)
        self.changed.discard(name)

    def broken(self, name: str) -> bool:
        try:
            self.load(name)
        except (ET.ParseError, ValueError):
            return True
        return False

    def bytes(self, name: str) -> bytes:
        if name in self.changed:
            self.content[name] = dump(*self.trees[name])
            self.changed.discard(name)
        return self.content[name]

    def all(self) -> dict[str, bytes]:
        return {name: self.bytes(name) for name in list(self.content)}


def w(tag: str, parent: ET.Element | None = None, **attributes: str) -> ET.Element:
    names = {f"{W}{k}": v for k, v in attributes.items()}
    return ET.Element(f"{W}{tag}", names) if parent is None else ET.SubElement(parent, f"{W}{tag}", names)


def _text_run(text: str, tag: str = "t", color: str | None = None, strike: bool = False) -> ET.Element:
    run = w("r")
    if color:
        properties = w("rPr", run)
        if strike:
            w("strike", properties)
        w("color", properties, val=color)
    w(tag, run).text = text
    run[-1].set(XML_SPACE, "preserve")
    return run


def paragraphs_by_id(document: ET.Element, notes: ET.Element | None) -> dict[str, list[ET.Element]]:
    """Element ids to their paragraphs: the addresses that scanning gives."""
    out: dict[str, list[ET.Element]] = {}
    body = document.find(f"{W}body")
    tops = [] if body is None else body.findall(f"{W}p")
    for n, p in enumerate(tops, 1):
        out[f"paragraph_{n}"] = [p]
    for t, table in enumerate([] if body is None else body.findall(f"{W}tbl"), 1):
        for r, row in enumerate(table.findall(f"{W}tr"), 1):
            c = 0
            for cell in row.findall(f"{W}tc"):
                span, own = cell.find(f"{W}tcPr/{W}gridSpan"), cell.findall(f"{W}p")
                for _ in range(int(span.get(f"{W}val", "1")) if span is not None else 1):
                    c += 1
                    out[f"table_{t}_cell_{r}_{c}"] = own
    n = 0
    for p in tops:
        for drawing in p.iter(f"{W}drawing"):
            if " ".join(t.text or "" for t in drawing.iter(f"{W}t")).strip():
                n += 1
                out[f"textbox_{n}"] = list(drawing.iter(f"{W}p"))
    n = 0
    for note in [] if notes is None else notes.findall(f"{W}footnote"):
        if note.get(f"{W}id") not in ("-1", "0") and "".join(t.text or "" for t in note.iter(f"{W}t")).strip():
            n += 1
            out[f"footnote_{n}"] = list(note.iter(f"{W}p"))
    return out


def header_parts(document: ET.Element, parts: Parts) -> list[tuple[str, str]]:
    """(kind, part name) of the default headers and footers of the first section, as scanning takes them."""
    rels = {r.get("Id"): r.get("Target") for r in parts.root(RELS)} if RELS in parts else {}
    # below the body, as in scanning
    first = None if document.find(f"{W}body") is None else next(document.iter(f"{W}sectPr"), None)
    found = [(k, r) for k in ("header", "footer") for r in ([] if first is None else first.findall(f"{W}{k}Reference")) if r.get(f"{W}type", "default") == "default"]
    return [(k, n) for k, r in found if (n := "word/" + (rels.get(r.get(REL_ID)) or "")) in parts]


class Editor:
    """Edits of one package."""

    def __init__(self, parts: dict[str, bytes], mode: str, author: str, date: str):
        self.parts, self.mode, self.author, self.date = Parts(parts), mode, author, date
        self.document = self.parts.root(DOCUMENT)
        self.notes = self.parts.root(NOTES) if NOTES in parts else None
        self.comment_tree = self.parts.load(COMMENTS) if parts.get(COMMENTS) else load(EMPTY_PARTS[COMMENTS].encode())
        self.comments = self.comment_tree[0]
        ids = [int(c.get(f"{W}id")) for c in self.comments if (c.get(f"{W}id") or "").lstrip("-").isdigit()]
        self.next_comment, self.next_change, self.commented = max(ids, default=-1) + 1, 1, False
        self.where = paragraphs_by_id(self.document, self.notes)
        self.headers: set[str] = set()
        counts = {"header": 0, "footer": 0}
        for kind, name in header_parts(self.document, self.parts):
            self.headers.add(name)
            for p in self.parts.root(name).findall(f"{W}p"):
                counts[kind] += 1
                self.where[f"{kind}_{counts[kind]}"] = [p]
        self.lines: dict[int, list[str]] = {}

    def texts(self) -> dict[str, str]:
        """Element ids to their texts, as scanning gives them. Ask before any edit."""
        return {element_id: text for _, element_id, _, text in elements_of(self.parts.content, self.parts.root)}

    def runs(self, segments: list[tuple[str, str]]) -> Callable[[Callable[[str], str]], str]:
        """How the segments are written: a run each, changed ones numbered."""
        groups: list[tuple[str, int, list[str]]] = []
        for kind, text in segments:
            if not text.isprintable() and ILLEGAL.search(text):
                raise ValueError("a change holds characters that XML can't")
            if kind != "text" and self.mode != "simple":
                groups.append((kind, self.next_change, [text if not text or text.endswith(ENDINGS) else f"{text} "]))
                self.next_change += 1
            elif groups and groups[-1][0] == kind:
                groups[-1][2].append(text)
            else:
                groups.append((kind, 0, [text]))
        attributes, simple = (self.author, self.date), self.mode == "simple"

        def write(name: Callable[[str], str]) -> str:
            n = lambda tag: name(f"{W}{tag}")
            run, space, out = n("r"), name(XML_SPACE), []
            for kind, number, texts in groups:
                properties, before, after = "", "", ""
                if kind != "text" and simple:
                    strike = f"<{n('strike')} />" if kind == "strike" else ""
                    color, val = n("color"), n("val")
                    properties = f'<{n("rPr")}>{strike}<{color} {val}="{RED if kind == "strike" else GREEN}" /></{n("rPr")}>'
                elif kind != "text":
                    change = n("del" if kind == "strike" else "ins")
                    before = f'<{change} {n("id")}="{number}" {n("author")}="{_quoted(attributes[0])}" {n("date")}="{_quoted(attributes[1])}">'
                    after = f"</{change}>"
                tag = n("delText" if kind == "strike" and not simple else "t")
                begin, end = f'{before}<{run}>{properties}<{tag} {space}="preserve"', f"</{run}>{after}"
                if "" in texts:
                    out += [f"{begin}>{_escaped(t)}</{tag}>{end}" if t else f"{begin} />{end}" for t in texts]
                else:
                    # a blank and a line break can't stand next to each other inside of one text: segments are words
                    out.append(f"{begin}>" + _escaped("\0".join(texts)).replace("\0", f"</{tag}>{end}{begin}>") + f"</{tag}>{end}")
            return "".join(out)

        return write

    def comment(self, paragraph: ET.Element, text: str) -> None:
        if ILLEGAL.search(text):
            raise ValueError("a motivation holds characters that XML can't")
        number, by, at = self.next_comment, _quoted(self.author), _quoted(self.date)

        def write(name: Callable[[str], str]) -> str:
            c, p, r, t, i, who, when = (name(f"{W}{x}") for x in ("comment", "p", "r", "t", "id", "author", "date"))
            return f'<{c} {i}="{number}" {who}="{by}" {when}="{at}"><{p}><{r}><{t} {name(XML_SPACE)}="preserve">{_escaped(text)}</{t}></{r}></{p}></{c}>'

        _drawn_up(self.comments, write, id=str(number))
        w("commentReference", w("r", paragraph), id=str(self.next_comment))
        self.next_comment += 1
        self.commented = True

    def paragraph(self, element_id: str, par_no: int) -> ET.Element | None:
        """The paragraph that is line ``par_no`` of a cell's scanned text, which leaves blank ones at its beginning out; of other elements the first."""
        paragraphs = self.where.get(element_id) or []
        if element_id.startswith("table_"):
            # of the paragraphs as they were, so that an edit doesn't move the lines of the next
            texts = self.lines.setdefault(id(paragraphs), []) if paragraphs else []
            texts += [paragraph_text(p) for p in paragraphs[len(texts) :]]
            first = next((k for k, t in enumerate(texts) if t.strip()), 0)
            # a paragraph with breaks is several lines: its others must not be lost
            return paragraphs[first + par_no] if first + par_no < len(paragraphs) and not any("\n" in t.strip() for t in texts[first : first + par_no + 1]) else None
        return paragraphs[0] if paragraphs else None

    def apply(self, element_id: str, segments: list[tuple[str, str]], motivation: str | None, par_no: int = 0) -> bool:
        """Rebuild the element's paragraph from segments; references in it stay, at its end."""
        p = self.paragraph(element_id, par_no)
        if p is None:
            return False
        keep = [r for r in p if r.tag == f"{W}r" and any(x.tag in REFERENCES for x in r.iter())]
        runs = self.runs(segments)
        for child in list(p):
            if child.tag != f"{W}pPr":
                p.remove(child)
        if segments:
            _drawn_up(p, runs)
        p.extend(keep)
        if motivation and not element_id.startswith(("footnote_", "header_", "footer_")):
            self.comment(p, motivation)
        return True

    def result(self) -> Parts:
        for name in (DOCUMENT, *([NOTES] if self.notes is not None else []), *self.headers):
            self.parts.change(name)
        if self.commented:
            self.parts.change(COMMENTS, self.comment_tree)
            _relate(self.parts, "comments.xml", COMMENTS_REL, None)
            _override(self.parts, "/word/comments.xml", COMMENTS_TYPE)
        return self.parts


def _relate(parts: Parts, target: str, kind: str, rid: str | None) -> bool:
    return _repaired(parts, RELS, _related, target, kind, rid)


def _repaired(parts: Parts, name: str, repair_part: Callable[..., bool], *how) -> bool:
    """Whether ``repair_part`` changed the part. What it makes of a small one is kept, as most packages have the same."""
    content = parts.content.get(name, b"")
    if name in parts.changed or len(content) > SMALL_PART:
        return repair_part(parts, *how)

    def make() -> tuple[bytes, bool]:
        alone = Parts({name: content} if name in parts else {})
        done = repair_part(alone, *how)
        return alone.all().get(name, b""), done

    after, done = _once((repair_part.__name__, content, name in parts, *how), make)
    if done:
        parts.replace(name, after)
    return done


def _related(parts: Parts, target: str, kind: str, rid: str | None) -> bool:
    root, prefixes = parts.load(RELS) if RELS in parts else (ET.Element(f"{{{RELS_NS}}}Relationships"), {"": RELS_NS})
    if any(r.get("Target") == target for r in root):
        return False
    used = {r.get("Id") for r in root}
    if rid is None or rid in used:
        rid = next(f"rId{n}" for n in range(1, len(used) + 2) if f"rId{n}" not in used)
    ET.SubElement(root, f"{{{RELS_NS}}}Relationship", {"Id": rid, "Type": kind, "Target": target})
    parts.change(RELS, (root, prefixes))
    return True


def _override(parts: Parts, name: str, kind: str) -> bool:
    return _repaired(parts, TYPES, _overridden, name, kind)


def _overridden(parts: Parts, name: str, kind: str) -> bool:
    if TYPES not in parts:
        return False
    root = parts.root(TYPES)
    if any(o.get("PartName") == name for o in root):
        return False
    ET.SubElement(root, f"{{{TYPES_NS}}}Override", {"PartName": name, "ContentType": kind})
    parts.change(TYPES)
    return True


COMMENT_REFERENCE, RUN_PROPERTIES, PROOFING_MARKS = f"{W}commentReference", f"{W}rPr", tuple(f"{W}{t}" for t in REMOVED_TAGS)


def _drop(root: ET.Element, tags: tuple[str, ...], gone=lambda x: True) -> int:
    """Remove all elements of the tags that ``gone`` holds for; how many there were."""
    # trees without any are the rule, and looking for a tag is quick
    if not any(gone(x) for tag in tags for x in root.iter(tag)):
        return 0
    n = 0
    for parent in list(root.iter()):
        for child in [x for x in parent if x.tag in tags and gone(x)]:
            parent.remove(child)
            n += 1
    return n


def _default_style(document: ET.Element, style: str = "Normal") -> int:
    """Give the paragraphs of the body that have no style the default one; how many there were."""
    n = 0
    for p in document.findall(f"{W}body/{W}p"):
        properties = p.find(f"{W}pPr")
        if properties is None:
            properties = w("pPr")
            p.insert(0, properties)
        if properties.find(f"{W}pStyle") is None:
            properties.insert(0, w("pStyle", val=style))
            n += 1
    return n


def repair(parts: dict[str, bytes]) -> tuple[dict[str, bytes], list[str]]:
    """The package's parts with all repairs, in their order, and what was done. Repairing twice does nothing more."""
    held = Parts(parts)
    done = repair_held(held)
    return held.all(), done


def repair_held(parts: Parts) -> list[str]:
    """The same to parts that are open already."""
    done = []
    for name, content in EMPTY_PARTS.items():
        bad = name == COMMENTS and name in parts and parts.broken(name)
        if name not in parts or bad:
            parts.replace(name, content.encode())
            done.append(f"{'replaced' if bad else 'created'} {name}")
    if _relate(parts, "comments.xml", COMMENTS_REL, None):
        done.append("related comments.xml")
    for target, kind, rid in COMMENT_RELATIONSHIPS:
        if _relate(parts, target, kind, rid):
            done.append(f"related {target}")
    for name, kind in ((f"/{COMMENTS}", COMMENTS_TYPE), *COMMENT_OVERRIDES):
        if _override(parts, name, kind):
            done.append(f"override {name}")
    if DOCUMENT in parts:
        document = parts.root(DOCUMENT)
        have = {c.get(f"{W}id") for c in parts.root(COMMENTS)}
        changed = {
            "dropped {} comment references": _drop(document, (COMMENT_REFERENCE,), lambda x: x.get(f"{W}id") not in have),
            "dropped {} proofing marks": _drop(document, PROOFING_MARKS),
            "dropped {} empty run properties": _drop(document, (RUN_PROPERTIES,), lambda x: not len(x)),
            "gave {} paragraphs the default style": _default_style(document),
        }
        if any(changed.values()):
            parts.change(DOCUMENT)
            done += [text.format(n) for text, n in changed.items() if n]
    if f"word/{THEME[0]}" in parts and _relate(parts, *THEME):
        done.append(f"related {THEME[0]}")
    if SETTINGS in parts:
        root, prefixes = parts.load(SETTINGS)
        fixed = False
        if root.find(f"{W}trackRevisions") is None:
            w("trackRevisions", root)
            done.append("set trackRevisions")
            fixed = True
        for tag, attributes in (("compat", {}), ("updateFields", {"val": "true"})):
            if root.find(f"{W}{tag}") is None:
                w(tag, root, **attributes)
                done.append(f"set {tag}")
                fixed = True
        rsids = root.find(f"{W}rsids")
        if rsids is None or not len(rsids):
            # ids come from the document's content, so a rerun makes the same ones
            seed = hashlib.sha256(parts.bytes(DOCUMENT) if DOCUMENT in parts else b"").hexdigest()
            n = sum(1 for _ in parts.root(DOCUMENT).iter(f"{W}p")) if DOCUMENT in parts else 0
            ids = [hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8].upper() for k in range(next((m for below, m in RSID_BUCKETS if n < below), MOST_RSIDS))]
            if rsids is not None:
                root.remove(rsids)
            rsids = w("rsids")
            w("rsidRoot", rsids, val=ids[0])
            _drawn_up(rsids, lambda name: "".join([f'<{name(f"{W}rsid")} {name(f"{W}val")}="{i}" />' for i in ids]))
            root.insert(0, rsids)
            done.append("added rsids")
            fixed = True
        if fixed:
            parts.change(SETTINGS, (root, {"w": W[1:-1], **prefixes}))
    done += [f"added style {i}" for i in _repaired(parts, STYLES, _styled)]
    return done


def _styled(parts: Parts) -> list[str]:
    """Add the required styles that are missing; their ids."""
    fresh = STYLES not in parts or parts.broken(STYLES)
    root, prefixes = (w("styles"), {"w": W[1:-1]}) if fresh else parts.load(STYLES)
    have = {s.get(f"{W}styleId") for s in root.iter(f"{W}style")}
    missing = [d for d in STYLE_DEFINITIONS if d[0] not in have]
    for style_id, kind, name, default in missing:
        style = w("style", root, type=kind, styleId=style_id)
        if default:
            style.set(f"{W}default", "1")
        w("name", style, val=name)
        if style_id == "Normal":
            w("qFormat", style)
        if style_id in BASED_ON_FONT:
            w("basedOn", style, val="DefaultParagraphFont")
    if missing or fresh:
        parts.change(STYLES, (root, prefixes))
    return [d[0] for d in missing]


def folded(edit, texts: dict[str, str]) -> tuple[list[tuple[str, str]], str | None, list[int], list[int]]:
    """(segments, motivation, numbers of made changes, of lost ones) of an edit that lists changes: applied in turn to the text that the package has there."""
    text, changes = texts.get(edit["element_id"] or "", ""), list(edit["changes"])
    if (edit["element_id"] or "").startswith("table_"):
        lines = text.split("\n")
        text = lines[edit["par_no"]] if edit["par_no"] < len(lines) else ""
    result, done = in_turn(text, [c["old"] or "" for c in changes], [c["new"] or "" for c in changes], THRESHOLD)
    segments = [("strike", text), ("insert", result)] if edit["whole"] else [(kind, val) for _, kind, val in ndiff_words(text, result)]
    motivations = [c["motivation"] for c, ok in zip(changes, done) if ok and c["motivation"] is not None]
    number = lambda wanted: [c["change_no"] for c, ok in zip(changes, done) if ok == wanted]
    return segments, "\n".join(motivations) or None, number(True), number(False)


EDITED = "path string, content binary, applied array<bigint>, failed array<bigint>, actions array<string>, error string"


def edit_packages(files: DataFrame, edits: DataFrame, mode: str = "simple", author: str = "quillmill", date: str = "2024-01-01T00:00:00Z", motivations: bool = True, limit: int = MAX_BYTES) -> DataFrame:
    """Files (path, content) with the edits (path, change_no, element_id, segments, motivation; par_no for paragraphs of cells) in them.

    ``mode`` simple colours the markup; tracked writes tracked changes and
    repairs the package. An element's later edits replace earlier ones, so
    give each element one; ``change_nos`` names the changes in it, if there
    are several, and ``lost_nos`` those that did not fit any more. Instead of
    segments, an edit may list ``changes`` (change_no, old, new, motivation):
    they are applied to the package's own text and told apart by words there,
    or as a ``whole``, so that no text is sent beside its package. A package that can't be read keeps its content
    and has an error. A package's edits are gathered into its row.
    """
    if "changes" in edits.columns:
        given = ["element_id", "par_no", "whole", "changes"]
    else:
        given = ["change_no", "element_id", "segments", "motivation", "change_nos", "lost_nos", "par_no"]
    if "changes" not in edits.columns and "change_nos" not in edits.columns:
        edits = edits.withColumn("change_nos", F.array("change_no")).withColumn("lost_nos", F.array().cast("array<bigint>"))
    if "par_no" not in edits.columns:
        edits = edits.withColumn("par_no", F.lit(0))
    listed = F.array_sort(F.collect_list(F.struct("change_no", *[c for c in given if c != "change_no"])))
    rows = files.select("path", "content").join(edits.groupBy("path").agg(listed.alias("edits")), "path", "left")

    def run(frames):
        import pandas as pd

        columns = ["path", "content", "applied", "failed", "actions", "error"]
        for frame in frames:
            out, size = [], 0
            for path, content, changes in zip(frame["path"], frame["content"], frame["edits"]):
                unpacked = unpack(path, bytes(content), limit)
                try:
                    if unpacked and unpacked[0][3]:
                        raise ValueError(unpacked[0][3])
                    editor = Editor({p[1]: p[2] for p in unpacked}, mode, author, date)
                    applied, failed = [], []
                    texts = editor.texts() if changes is not None and "changes" in given else {}
                    for e in [] if changes is None else changes:
                        segments, motivation, made, lost = folded(e, texts) if "changes" in given else ([(s["kind"], s["val"]) for s in e["segments"]], e["motivation"], e["change_nos"], e["lost_nos"])
                        (applied if editor.apply(e["element_id"] or "", segments, motivation if motivations else None, int(e["par_no"])) else failed).extend(int(n) for n in made)
                        failed.extend(int(n) for n in lost)
                    result = editor.result()
                    actions = repair_held(result) if mode == "tracked" else []
                    out.append((path, pack(list(result.all().items())), applied, failed, actions, None))
                except (ValueError, KeyError, ET.ParseError) as e:
                    out.append((path, bytes(content), [], [], [], f"{type(e).__name__}: {e}"))
                size += len(out[-1][1])
                if size >= FRAME_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, EDITED)


def repair_packages(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """(path, content, actions, error): repaired packages. One that can't be read keeps its content and has an error."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                unpacked = unpack(path, bytes(content), limit)
                try:
                    if unpacked and unpacked[0][3]:
                        raise ValueError(unpacked[0][3])
                    result, actions = repair({p[1]: p[2] for p in unpacked})
                    out.append((path, pack(list(result.items())), actions, None))
                except (ValueError, KeyError, ET.ParseError) as e:
                    out.append((path, bytes(content), [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "content", "actions", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, actions array<string>, error string")
