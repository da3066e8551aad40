"""Benchmark decontamination with an FM-index per shard of the training texts.

The phrases are the windows of ten words of every benchmark item (an item of
fewer words is one phrase). Each task cuts its documents into shards. In a
shard, words become numbers of the benchmark's vocabulary; a run of such
words shorter than the shortest phrase can't hold one and is left out, the
remaining runs are put behind each other with separators. Over them an
FM-index is built: suffix array by prefix doubling, Burrows-Wheeler transform
in a wavelet matrix, positions sampled. All phrases are searched backward at
once; occurrences are located by walking to sampled positions, and their word
spans merged per document.

The benchmark is read in blocks of a bounded number of words; each block is one
pass over the documents. Nothing about the documents leaves their task but the
result, so there is no shuffle for one block; for several, rows are numbered
in a staged table and the findings of all passes merged by that number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

WINDOW = 10
#: Words of benchmark text per pass; bounds what is broadcast.
BLOCK_WORDS = 2_000_000
#: A shard is indexed when it holds this many words of the vocabulary, documents, or bytes of text.
SHARD_WORDS, SHARD_DOCS, SHARD_BYTES = 1 << 20, 20_000, 32 << 20
SAMPLE = 32

#: A-Z to lower case; ASCII other than digits and letters to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words, to find where they stand.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class FMIndex:
    """Over a sequence of numbers; 0 separates runs and is never searched for."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        n = len(seq)
        self.n, sa = n, self._suffixes(seq)
        bwt = seq[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        starts = np.ones(n, dtype=bool)
        starts[1:] = seq[:-1] == 0
        marked = (sa % sample == 0) | starts[sa]
        self.marks, self.values = np.concatenate(([0], np.cumsum(marked))), sa[marked]
        self.levels, at = [], bwt
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = (at >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))), n - int(ones.sum())))
            at = np.concatenate((at[ones == 0], at[ones == 1]))
        self.origin = self._down(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling. Separators differ from each other, so no comparison crosses two."""
        n = len(seq)
        zero = seq == 0
        rank = np.where(zero, np.cumsum(zero) - 1, seq.astype(np.int64) + int(zero.sum()))
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        width = 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + after
            sa = np.argsort(key, kind="stable")
            new = np.empty(n, dtype=np.int64)
            new[sa] = np.concatenate(([0], np.cumsum(np.diff(key[sa]) != 0)))
            rank, width = new, width * 2
            if rank[sa[-1]] == n - 1 or width >= n:
                return sa

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            r = ones[at]
            at = np.where((symbol >> bit) & 1 == 1, zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each position."""
        return self._down(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, right-aligned): ranges of the suffix array."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, -k]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back until a sampled one; runs start with one."""
        out, at, steps = np.empty(len(rows), dtype=np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            i = at[open_]
            done = self.marks[i + 1] > self.marks[i]
            out[open_[done]] = self.values[self.marks[i[done]]] + steps
            open_ = open_[~done]
            i, symbol = at[open_], np.zeros(len(open_), dtype=np.int64)
            for bit, ones, zeros in self.levels:
                r = ones[i]
                one = ones[i + 1] > r
                symbol |= one.astype(np.int64) << bit
                i = np.where(one, zeros + r, i - r)
            at[open_] = self.first[symbol] + i - self.origin[symbol]
            steps += 1
        return out


class Phrases:
    """Vocabulary and distinct windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.items = [sorted(i for i in s if i is not None) for s in found.values()]
        self.matrix = np.zeros((len(found), int(self.lengths.max()) if found else 0), dtype=np.int64)
        for row, p in zip(self.matrix, found):
            row[len(row) - len(p) :] = p
        self.shortest = int(self.lengths.min()) if found else 0

    def plain(self) -> dict:
        """The content without the class: what is broadcast must not need this module where it arrives."""
        return vars(self)

    @classmethod
    def of(cls, plain: dict) -> Phrases:
        out = cls.__new__(cls)
        vars(out).update(plain)
        return out


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


class Shard:
    """Documents of a task until they are indexed and searched."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.runs, self.size, self.bytes = phrases, [], [], 0, 0

    def add(self, doc_id, text: bytes | None) -> None:
        ws = tokens(text) if text else []
        self.bytes += len(text or b"")
        n, least = len(ws), self.phrases.shortest
        kept = False
        if least and n >= least:
            get = self.phrases.vocabulary.get
            ids = np.array([get(w, 0) for w in ws], dtype=np.int32)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= least:
                    self.runs.append((len(self.docs), int(a), ids[a:b]))
                    self.size += int(b - a) + 1
                    kept = True
        self.docs.append((doc_id, n, text if kept else None))

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or len(self.docs) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def results(self) -> Iterator[dict]:
        hits: dict[int, tuple[list, set]] = {}
        if self.runs:
            gap = np.zeros(1, dtype=np.int32)
            seq = np.concatenate([x for _, _, ids in self.runs for x in (ids, gap)])
            sizes = np.array([len(ids) + 1 for _, _, ids in self.runs])
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            index = FMIndex(seq, len(self.phrases.vocabulary) + 1)
            lo, hi = index.search(self.phrases.matrix, self.phrases.lengths)
            which = np.repeat(np.arange(len(lo)), np.maximum(0, hi - lo))
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if a < b]) if len(which) else which
            at = index.locate(rows)
            run = np.searchsorted(begins, at, side="right") - 1
            owner, word = np.array([r[0] for r in self.runs]), np.array([r[1] for r in self.runs])
            doc, start = owner[run], word[run] + at - begins[run]
            end = start + self.phrases.lengths[which]
            order = np.argsort(doc, kind="stable")
            cuts = np.flatnonzero(np.diff(doc[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                items = set()
                for p in np.unique(which[part]):
                    items.update(self.phrases.items[p])
                hits[int(doc[part[0]])] = (_merged(start[part], end[part]), items)
        for k, (doc_id, n, text) in enumerate(self.docs):
            spans, items = hits.get(k, ([], set()))
            out = {"doc_id": doc_id, "n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items), "removal": []}
            if spans:
                at = [m.span() for m in WORD.finditer(text.decode("utf-8", "surrogatepass"))]
                out["removal"] = [{"start": at[s][0], "end": at[e - 1][1]} for s, e in spans]
            yield out


SPAN = "array<struct<start:long,end:long>>"
RESULT = f"doc_id long, n_words long, spans {SPAN}, items array<long>, removal {SPAN}"


def _scan(phrases):
    """A function over Arrow batches; ``phrases`` is a broadcast of Phrases.plain()."""

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.int64())), ("removal", span)])
        wanted = Phrases.of(phrases.value)
        shard = Shard(wanted)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()) if not pa.types.is_large_binary(batch.column(1).type) else batch.column(1)
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                shard.add(doc_id, text.as_py())
                if shard.full():
                    yield pa.RecordBatch.from_pylist(list(shard.results()), schema=schema)
                    shard = Shard(wanted)
        if shard.docs:
            yield pa.RecordBatch.from_pylist(list(shard.results()), schema=schema)

    return run


def _clean(phrases, column: int):
    """A function that passes on the rows in whose text (the column of that number) no phrase occurs."""

    def run(batches):
        import pyarrow as pa

        wanted = Phrases.of(phrases.value)
        shard, held = Shard(wanted), []

        def flush():
            clean = [not r["spans"] for r in shard.results()]
            for batch in held:
                yield batch.filter(pa.array(clean[: batch.num_rows]))
                del clean[: batch.num_rows]

        for batch in batches:
            for text in batch.column(column).cast(pa.large_binary()):
                shard.add(None, text.as_py())
            held.append(batch)
            if shard.full():
                yield from flush()
                shard, held = Shard(wanted), []
        yield from flush()

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any phrase of the benchmark, with all columns, whatever their names.

    Blocks of the benchmark filter one after the other; nothing is shuffled.
    Rows are judged one by one, so ids may be null or repeated. Null and empty
    texts hold no phrase; null or wordless items have none; an empty benchmark or table changes nothing.
    """
    out = small_batches(docs)
    for block in _blocks(benchmark, block_words):
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, window).plain())
        out = out.mapInArrow(_clean(phrases, docs.columns.index("text")), docs.schema)
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list]:
    """The benchmark in blocks of about ``block_words`` words, streamed partition by partition."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").toLocalIterator():
        text = r[1].encode()
        block.append((r[0], text))
        size += len(text) // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, merged ``spans`` of words, ``items`` met, and ``removal`` spans of code points.

    Every row is in the result, with empty arrays if nothing was found; a null
    text has no words. Items without an id count as hits but are not listed.
    Repeated and null doc_ids keep a row each: for several benchmark blocks
    the rows are numbered in a staged table, and the passes merged by number.
    """
    spark = docs.sparkSession
    slim = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    blocks = _blocks(benchmark, block_words)
    scan = lambda rows, block: rows.mapInArrow(_scan(spark.sparkContext.broadcast(Phrases(block, window).plain())), RESULT)
    block, more = next(blocks, []), next(blocks, None)
    if more is None:
        return scan(slim, block)
    rows = staged(slim.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    passes = [scan(numbered, block)] + [scan(numbered, b).filter("size(spans) > 0") for b in chain([more], blocks)]
    found = [p.withColumnRenamed("doc_id", "row").withColumn("doc_id", F.lit(None).cast("long")) for p in passes]
    owners = rows.select("row", "doc_id")  # its other columns are null, which no aggregate counts
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [*found, owners]).groupBy("row")
    pairs = F.flatten(F.collect_list(F.arrays_zip("spans", "removal")))
    merged = every.agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), merge_spans(pairs).alias("both"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", F.col("both.spans").alias("spans"), "items", F.col("both.removal").alias("removal"))


def merge_spans(pairs):
    """Union of spans of words that touch or overlap, sorted; each takes the code points of what it unites along."""
    last = lambda acc: F.element_at(acc, -1)
    end = lambda a, x, c: F.struct(a[c]["start"].alias("start"), F.greatest(a[c]["end"], x[c]["end"]).alias("end")).alias(c)
    both = lambda a, x: F.array(F.struct(end(a, x, "spans"), end(a, x, "removal")))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["spans"]["end"] >= x["spans"]["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), both(last(acc), x))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(pairs), F.array().cast("array<struct<spans:struct<start:long,end:long>,removal:struct<start:long,end:long>>>"), step)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest columns per document: words, hit words, items, their checksum, verdict."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return find(docs, benchmark).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
