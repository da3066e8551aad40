"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay. Looser patterns propose
candidate spans of more kinds; the base spans are candidates, too, so that the
labelers' reliabilities rest on all of them. Five labelers (form, checksum,
gazetteer, context, neighbours) vote on every candidate: for, against, or not
at all. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; a
logistic span classifier learns those probabilities from the votes, the kind
and the span's length. Candidates that it accepts, and that touch no base span,
are added.

One pass over the texts stages spans and candidates. What is collected is a
count per (kind, votes, length class): at most kinds * 3**5 * classes rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Kinds in the order of results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "national_id", "iban", "name")
BASE = 4
LABELERS = ("form", "checksum", "gazetteer", "context", "neighbours")
SIZE_CLASSES = 4

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can only begin where a run begins: within one it would have begun earlier. So runs
# are entered at their first character and never given back, and time grows with the text's length.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Candidate patterns: (kind, what must be in the text, pattern). The first of two that overlap stands, so the stricter ones lead.
CANDIDATES = (
    (0, ("(at)", "[at]", " at ", "(dot)", "[dot]"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++")),
    (5, (), re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (4, ("-",), re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (2, (), re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])")),
    (3, (), re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")),
    (6, ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor"), re.compile(r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Señora?)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?")),
)
#: Gazetteers and context words (fixed values).
MAIL_HOSTS = ("gmail", "yahoo", "hotmail", "outlook", "example", "mail", "proton", "gmx", "web")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "se", "no", "dk", "fi", "nl", "be", "at", "ch", "pt", "pl", "eu")
FIRST_NAMES = frozenset(
    """Aisha Alexander Alice Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Björn Carlos Carmen Caroline Catherine Charles
    Charlotte Christian Christina Christine Christopher Claire Claudia Daniel David Diego Elena Elisabeth Elizabeth Emily Emma Eric Erik Eva Fatima Felix
    Francisco Franz François Frank Frida Gabriel George Hannah Hans Helen Helena Henry Ingrid Isabel Isabelle Ivan Jack Jacob Jacques James Jan Jane Javier
    Jean Jennifer Jessica Johan Johanna John Jonas Jorge Joseph José Juan Julia Julie Jürgen Karin Karl Katarina Katharina Kevin Klaus Kwame Lars Laura Lena
    Linda Lisa Louis Lucas Lucía Luis Lukas Manuel Margaret Maria Marie Mark Markus Martin Mary Mateo Matthew Max Michael Miguel Mohammed Monika Nadia Nicole
    Nils Nina Olga Oliver Olivia Oscar Otto Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Rebecca Richard Robert Rosa Samuel Sandra Sara Sarah
    Sebastian Simon Sofia Sophie Stefan Stephen Susan Sven Thomas Tomás Ulrike Victoria Walter William Wolfgang Yusuf Yves Zoltan""".split()
)
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25}
CONTEXT_FOR = (
    re.compile(r"(?i)mail|contact|write|reach"),
    re.compile(r"(?i)\bip\b|address|host|server"),
    re.compile(r"(?i)card|visa|master|credit|pay"),
    re.compile(r"(?i)tel|phone|call|mobile|fax|contact|whatsapp"),
    re.compile(r"(?i)ssn|social|security|national|\bid\b"),
    re.compile(r"(?i)iban|account|bank|konto"),
    re.compile(r"(?i)name|dear|regards|contact|signed"),
)
CONTEXT_AGAINST = re.compile(r"(?i)version|isbn|order|invoice|serial|total|price|chapter|page|build|figure|table")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return IBAN_LENGTHS.get(s[:2], len(s)) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _no_zeros(number: str) -> str:
    return number.lstrip("0")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = []
    if "@" in t:
        # the run of local characters before an @ starts as far left as it goes, but not before the last match's end
        done = 0
        for m in AT.finditer(t):
            s = m.start()
            while s > done and t[s - 1] in LOCAL:
                s -= 1
            if s < m.start():
                out.append((0, s, m.end()))
                done = m.end()
    if DIGIT.search(t):
        out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(len(p) <= 3 and int(p or 0) <= 255 for p in map(_no_zeros, m.group().split(".")))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in t:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def votes(t: str, kind: int, s: int, e: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes on a span: 1 for, 2 against, 0 none."""
    span = t[s:e]
    d = digits_of(span)
    form = checksum = gazetteer = 0
    if kind == 0:
        host = span.rsplit(")" if ")" in span else "]" if "]" in span else " ", 1)[-1].strip()
        plain = host == host.lower() and host.rsplit(".", 1)[-1] in TOP_DOMAINS
        form = 1 if base or plain or re.search(r"[(\[]at[)\]]", span) else 2
        gazetteer = 1 if any(h in span.lower() for h in MAIL_HOSTS) else 0
    elif kind == 1:
        form = checksum = 1
    elif kind == 2:
        form, checksum = 1 if len(d) in (15, 16) else 2, 1 if luhn(d) else 2
        gazetteer = 1 if d[:1] in "3456" else 0
    elif kind == 3:
        form = 1 if base or (len(d) == 10 and ("(" in span or (d[0] > "1" and d[3] > "1"))) else 0 if len(d) == 10 else 2
        gazetteer = 2 if len(set(d)) < 3 else 0
    elif kind == 4:
        form = 1
        checksum = 2 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 0
    elif kind == 5:
        checksum = 1 if iban_ok(span) else 2
        gazetteer = 1 if span[:2] in IBAN_LENGTHS else 2
    else:
        gazetteer = 1 if any(n in FIRST_NAMES for n in span.split()) else 0
        form = 1 if len(span.split()) > 2 else 0
    before = t[max(0, s - 30) : s]
    context = 1 if CONTEXT_FOR[kind].search(before) else 2 if CONTEXT_AGAINST.search(before) else 0
    glued = (s and t[s - 1].isalnum()) or (e < len(t) and t[e].isalnum())
    return form, checksum, gazetteer, context, 2 if glued else 0


def size_class(n: int) -> int:
    return 0 if n < 10 else 1 if n < 16 else 2 if n < 24 else 3


def code_of(v: tuple[int, ...], size: int) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out * SIZE_CLASSES + size


def decode(code: int) -> tuple[list[int], int]:
    v, size = [], code % SIZE_CLASSES
    code //= SIZE_CLASSES
    for _ in LABELERS:
        v.append(code % 3)
        code //= 3
    return v[::-1], size


def united(spans) -> list[tuple[int, int]]:
    """The spans, sorted, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan_text(t: str) -> tuple[list, list]:
    """Base spans (kind, start, end) and candidates (kind, start, end, code, is base)."""
    base = base_spans(t)
    found = [(k, s, e, code_of(votes(t, k, s, e, True), size_class(e - s)), True) for k, s, e in base]
    digits = bool(DIGIT.search(t))
    taken = united((s, e) for _, s, e in base)
    for kind, needs, pattern in CANDIDATES:
        if (kind in (0, 6) or digits) and (not needs or any(x in t for x in needs)):
            starts, fresh = [a for a, _ in taken], []
            for m in pattern.finditer(t):
                s, e = m.span()
                k = bisect_left(starts, e)  # the spans before k begin before this one ends; the last of them ends last
                if not k or taken[k - 1][1] <= s:
                    found.append((kind, s, e, code_of(votes(t, kind, s, e, False), size_class(e - s)), False))
                    fresh.append((s, e))
            taken = united(taken + fresh) if fresh else taken
    return base, found


def _scan(batches):
    import pyarrow as pa

    span = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct(span))), ("found", pa.list_(pa.struct([*span, ("code", pa.int32()), ("is_base", pa.bool_())])))])
    for batch in batches:
        base, found = [], []
        for text in batch.column(1):
            b, f = scan_text(text.as_py() or "")
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in b])
            found.append([{"kind": k, "start": s, "end": e, "code": c, "is_base": x} for k, s, e, c, x in f])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(base, schema.field(1).type), pa.array(found, schema.field(2).type)], schema=schema)


SPAN = "struct<kind:int,start:long,end:long>"
SCANNED = f"doc_id long, base array<{SPAN}>, found array<struct<kind:int,start:long,end:long,code:int,is_base:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """Spans and candidates of every whole text; a null text has none."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_scan, SCANNED)


class SpanModel:
    """Reliabilities by expectation-maximisation, then a logistic classifier of spans."""

    def __init__(self, rows: list[tuple[int, int, int]], rounds: int = 50):
        """rows: (kind, code, count)."""
        self.accepted: set[tuple[int, int]] = set()
        self.reliability: dict[str, tuple[float, float]] = {}
        if not rows:
            return
        kinds = np.array([r[0] for r in rows])
        decoded = [decode(r[1]) for r in rows]
        v, size, n = np.array([d[0] for d in decoded]), np.array([d[1] for d in decoded]), np.array([r[2] for r in rows], dtype=float)
        # start from the majority of votes; pseudo-counts keep every labeler better than chance until the data say otherwise
        share = (v == 1).sum(1) - 1.5 * (v == 2).sum(1)
        q = 1 / (1 + np.exp(-1.5 * share))
        right, wrong = 0.8 * max(10.0, n.sum() / 10), 0.2 * max(10.0, n.sum() / 10)
        for _ in range(rounds):
            yes, no = n * q, n * (1 - q)
            odds = np.zeros(len(n))  # no kind is likelier than not before the labelers speak
            for j, name in enumerate(LABELERS):
                # a labeler that does not vote says nothing
                speaks, says = v[:, j] > 0, v[:, j] == 1
                for_yes = (yes[says].sum() + right) / (yes[speaks].sum() + right + wrong)
                against_no = (no[speaks & ~says].sum() + right) / (no[speaks].sum() + right + wrong)
                odds += np.where(says, np.log(for_yes / (1 - against_no)), np.where(speaks, np.log((1 - for_yes) / against_no), 0.0))
                self.reliability[name] = (float(for_yes), float(against_no))
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        x = np.column_stack([np.ones(len(n)), *[(v == k)[:, j] for j in range(len(LABELERS)) for k in (1, 2)], *[kinds == k for k in range(len(KINDS))], *[size == k for k in range(SIZE_CLASSES)]]).astype(float)
        weight = np.zeros(x.shape[1])
        share = np.sqrt(n) / np.sqrt(n).sum()
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ weight))
            hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            weight += np.linalg.solve(hessian, x.T @ (share * (q - p)) - 1e-3 * weight)
        p = 1 / (1 + np.exp(-x @ weight))
        # the classifier alone decides which candidates are added
        self.accepted = {(int(k), r[1]) for k, r, a in zip(kinds, rows, p) if a >= 0.5}


def fit(scanned: DataFrame) -> SpanModel:
    rows = scanned.select(F.explode("found").alias("x")).groupBy("x.kind", "x.code").count().collect()
    return SpanModel(sorted((r["kind"], r["code"], r["count"]) for r in rows))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(spans)
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` spans and all ``spans`` (kind index, start, end; code points, end exclusive).

    One row per row of ``docs``, whatever its id; other columns don't matter. A
    null or empty text has no span. Of candidates that overlap the one of the
    earlier pattern stands, then the one that begins first. An empty table gives an empty result.
    """
    scanned = staged(scan(small_batches(docs)), "pii")
    accepted = fit(scanned).accepted
    code = lambda x: x["kind"] * 1_000_000 + x["code"]
    codes = F.array(*[F.lit(k * 1_000_000 + c) for k, c in sorted(accepted)]).cast("array<int>")
    added = F.filter("found", lambda x: ~x["is_base"] & F.array_contains(codes, code(x)))
    plain = F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scanned.select("doc_id", "base", F.concat("base", plain).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, checksum of the base spans, and all spans, one row per row of ``docs``, as `detect` has them."""
    found = detect(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
