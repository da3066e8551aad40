import hashlib
import random
import re

import numpy as np

from quillmill.llm import decontam as d

BENCH = "item_id long, text string"


def ws(t):
    t = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = ws(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    lengths = sorted({len(w) for w in windows})
    for i, t in docs:
        w, hit, items = ws(t), set(), set()
        for k in range(len(w)):
            for n in lengths:
                if k + n <= len(w) and (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[x]
        items.discard(None)
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, make_docs, docs, bench):
    df = d.contamination(make_docs([(i, t, "s") for i, t in docs]), spark.createDataFrame(bench, BENCH))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases():
    rng = random.Random(4)
    words = ["the", "Of", "x1", "é", "to", "a"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    bench = [(1, make(12)), (2, make(30)), (3, "the of"), (11, "to é, TO"), (None, make(11)), (5, ""), (6, None), (7, "..."), (2, make(14)), (8, bench8 := make(25)), (9, bench8)]
    docs = [(i, make(rng.randint(0, 60))) for i in range(40)] + [(100 + k, make(20) + (bench[k][1] or "") + make(5)) for k in range(len(bench))]
    return docs + [(None, None), (7, ""), (7, ""), (8, "Zz " * 500 + bench8 + " qq " + bench8), (9, bench8 * 40)], bench


def test_like_brute_force(spark, make_docs):
    docs, bench = cases()
    assert run(spark, make_docs, docs, bench) == brute(docs, bench)
    long_only = [b for b in bench if len(ws(b[1])) >= 10]
    assert run(spark, make_docs, docs, long_only) == brute(docs, long_only)


def test_small_shards_and_blocks(spark, make_docs, monkeypatch):
    docs, bench = cases()
    monkeypatch.setattr(d, "SHARD_WORDS", 50)
    assert run(spark, make_docs, docs, bench) == brute(docs, bench)
    distinct = list({i: (i, t) for i, t in docs}.values())
    found = d.find(make_docs([(i, t, "s") for i, t in distinct]), spark.createDataFrame(bench, BENCH), block_words=20)
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) for r in found.collect()), key=repr)
    assert got == sorted((x[:4] for x in brute(distinct, bench)), key=repr)


def test_blocks_keep_every_row(spark, make_docs):
    """Null and repeated doc_ids stay rows of their own, and spans are the same as for one block."""
    docs, bench = cases()
    docs += [(None, bench[0][1]), (None, "the of " + bench[1][1]), (100, "nothing"), (100, bench[8][1])]
    frame, items = make_docs([(i, t, "s") for i, t in docs]), spark.createDataFrame(bench, BENCH)
    key = lambda df: sorted((repr(r) for r in df.collect()))
    assert key(d.find(frame, items, block_words=20)) == key(d.find(frame, items))


def test_tables_like_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert sorted((tuple(r) for r in d.contamination(docs, bench).collect()), key=repr) == want
    assert any(x[-1] for x in want)


def test_removal_spans_cover_the_words(spark, make_docs):
    phrase = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, phrase)], BENCH)
    docs = make_docs([(1, "é Start! " + phrase.replace(" ", ", ") + " eleven. End", "s")])
    r = d.find(docs, bench).first()
    t = docs.first()["text"]
    assert [t[s["start"] : s["end"]] for s in r["removal"]] == [phrase.replace(" ", ", ")]


def test_empty(spark, make_docs):
    assert run(spark, make_docs, [], [(1, "a b")]) == []
    assert run(spark, make_docs, [(1, "a b")], [])[0][:4] == (1, 2, 0, 0)


def test_index_counts_and_positions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        seq = np.concatenate((rng.integers(0, 4, rng.integers(1, 200)), [0])).astype(np.int32)
        index = d.FMIndex(seq, 4, sample=7)
        phrases = np.zeros((20, 4), dtype=np.int64)
        lengths = rng.integers(1, 5, 20)
        for row, n in zip(phrases, lengths):
            row[4 - n :] = rng.integers(1, 4, n)
        lo, hi = index.search(phrases, lengths)
        for row, n, a, b in zip(phrases, lengths, lo, hi):
            want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == row[4 - n :]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
