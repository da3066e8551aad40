import random
import re

import numpy as np
import pytest

from quillmill.llm import ngram_join as j


def brute(rows, k=4, num=85, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and rows[a][0] is not None and rows[b][0] is not None and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(sets[x]), least[find(x)] if i is not None else None) for x, (i, _) in enumerate(rows)), key=repr)


def run(make_docs, rows, spec=j.Spec()):
    return sorted((tuple(r) for r in j.link(make_docs([(i, t, "s") for i, t in rows]), spec).collect()), key=repr)


def corpus(seed):
    """Families of near copies around the threshold, shared passages, short texts, copies, odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, i = [(None, "a b c d e f g"), (3, None), (2, ""), (1, " \n "), (900, "A b C"), (901, "a B c"), (902, "a b"), (903, "a b c d"), (904, "A B C D")], 10
    for size, copies in ((30, 40), (120, 90), (9, 20), (8, 20), (400, 12), (12, 30)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                at = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[at] = rng.choice(vocabulary)
                else:
                    text.insert(at, rng.choice(vocabulary))
            rows.append((i, " ".join(text)))
            i += 1
    for _ in range(60):
        rows.append((i, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] + passage)))
        i += 1
    for _ in range(30):
        rows.append((i, rng.choice(rows)[1]))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent,group,drawn,part", [(16, 64, 64, 2048), (2, 3, 7, 11), (10**9, 5, 16, 3), (3, 12, 2, 64)])
def test_like_brute_force(spark, make_docs, monkeypatch, frequent, group, drawn, part):
    monkeypatch.setattr(j, "FREQUENT", frequent)
    monkeypatch.setattr(j, "PAIR_GROUP", group)
    monkeypatch.setattr(j, "DRAWN", drawn)
    monkeypatch.setattr(j, "PART", part)
    rows = corpus(frequent % 97)
    assert run(make_docs, rows) == brute(rows)


def test_halves_of_hashes_may_clash(spark, make_docs, monkeypatch):
    """With first halves of five bits nearly all sets clash; the outcome is the same."""
    whole = j._digest
    monkeypatch.setattr(j, "_digest", lambda tokens: (whole(tokens)[0] & 31, whole(tokens)[1]))
    rows = corpus(8)[:150]
    assert run(make_docs, rows) == brute(rows)


def test_other_threshold_and_shingle(spark, make_docs):
    rows = corpus(5)
    assert run(make_docs, rows, j.Spec(5, 80, 100)) == brute(rows, 5, 80, 100)


def test_tables_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in j.link(docs).collect()), key=repr) == brute(rows)


def test_prefixes_meet():
    """Whenever two sets are linked, their signatures meet, whatever the class of frequent tokens."""
    rng = np.random.default_rng(3)
    spec = j.Spec()
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        x = rng.choice(500, n, replace=False).astype(np.uint64) + np.uint64(1)
        drop, add = rng.integers(0, n // 8 + 1), rng.integers(0, n // 8 + 1)
        y = np.unique(np.concatenate((x[drop:], rng.choice(500, add, replace=False).astype(np.uint64) + np.uint64(1))))
        x = np.unique(x)
        shared = len(np.intersect1d(x, y))
        if not len(y) or not spec.linked(shared, len(x), len(y)) or (len(x) == len(y) == shared):
            continue
        often = np.unique(rng.choice(500, int(rng.choice([0, 50, 250, 450, 500])), replace=False).astype(np.uint64) + np.uint64(1))
        times = rng.integers(16, 30, len(often))
        a, b = j.signatures(x, spec, often, times), j.signatures(y, spec, often, times)
        met = len(np.intersect1d(a[0], b[0]))
        assert met >= (spec.common if a[2] and b[2] else 1) or len(np.intersect1d(a[1], b[1]))


def test_empty_table_and_one_kept(spark, make_docs):
    assert run(make_docs, []) == []
    t = " ".join(f"w{i}" for i in range(100))
    docs = make_docs([(5, t, "a"), (4, t + " x", "b"), (9, "alone here", "c"), (None, t, "d"), (7, None, "e")]).selectExpr("*", "1 as node", "2 as component")
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["source"] for r in kept.collect()) == ["b", "c", "d", "e"]
