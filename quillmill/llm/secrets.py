"""Secret scans with an incremental ledger of blobs.

Every version of every file is a blob, addressed by the SHA-256 of its
content. The ledger is a Parquet table of (blob, rule_version, findings). A
scan looks only at blobs that the ledger lacks for the current version of the
rules, each once however many paths and versions share it, appends what it
found, and joins the findings of all blobs back to all paths.

Copies are dropped before the shuffle (partial aggregation), so a blob that a
third of all paths share crosses the network once per map task; the join back
to the paths moves no text, and Spark can split its large partitions.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import small_batches

#: Kinds in the order of results; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "slack", "google", "jwt", "private_key")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Added kinds: (kind, what must be in the text, pattern). Runs are entered at their beginning and not given back, so time grows with the text's length.
ADDED = (
    (3, "gh", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}")),
    (4, "xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    (5, "AIza", re.compile(r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    (6, "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    (7, "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")),
)
#: Findings depend on the patterns alone, so these name the version of the rules.
RULE_VERSION = hashlib.sha256("\n".join([ASSIGN.pattern, ACCESS.pattern, HEX.pattern, *[p.pattern for _, _, p in ADDED]]).encode()).hexdigest()[:16]

FINDINGS = "array<struct<start:long,kind:int,end:long>>"
LEDGER = f"blob string, rule_version string, findings {FINDINGS}"


def scan_text(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    if ":" in t or "=" in t:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
    for kind, needs, pattern in ADDED:
        if needs in t:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(t)]
    return sorted(out)


def _scan(batches):
    import pyarrow as pa

    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    schema = pa.schema([("blob", pa.string()), ("findings", spans)])
    for batch in batches:
        found = [[{"start": s, "kind": k, "end": e} for s, k, e in scan_text(x.as_py())] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(found, spans)], schema=schema)


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def known_blobs(spark, ledger: str, rule_version: str) -> DataFrame | None:
    """The ledger's blobs for these rules; None while there is no ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def update_ledger(versions: DataFrame, text: str, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of ``versions`` that the ledger lacks, append them, return the ledger for these rules.

    An append that is repeated after a lost driver can list a blob twice, with
    equal findings; readers take one.
    """
    spark = small_batches(versions).sparkSession
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = versions.select(blob_of(F.col(text).cast("string")).alias("blob"), content.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    known = known_blobs(spark, ledger, rule_version)
    if known is not None:
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    found = blobs.select("blob", "content").mapInArrow(_scan, f"blob string, findings {FINDINGS}")
    found.select("blob", F.lit(rule_version).alias("rule_version"), "findings").write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version)


def scan_versions(versions: DataFrame, key: str, text: str, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """``key``, blob and findings of every row of ``versions`` (path, commit, document ...).

    A null text is the empty blob. Rows with null or repeated keys keep their
    own row. An empty table scans nothing.
    """
    entries = update_ledger(versions, text, ledger, rule_version)
    hits = entries.filter(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
    rows = versions.select(F.col(key), blob_of(F.col(text).cast("string")).alias("blob"))
    return rows.join(hits, "blob", "left").select(key, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def joined(findings: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts of the base kinds, checksum of the base spans, and all spans, per document.

    Without a ledger's path, a new one is started in the shared folder.
    """
    ledger = ledger or fresh_path(docs.sparkSession, "secret-ledger")
    found = scan_versions(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), "doc_id", "text", ledger)
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("findings", lambda x: x["kind"] < 3)
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), "blob")
