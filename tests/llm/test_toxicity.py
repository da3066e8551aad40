import itertools
import math
import random
import re
import time
import zlib

import pyarrow.parquet as pq

from quillmill.llm import toxicity as x

SF = "/root/testdata/sf0.1"
DOCS = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]


def model(words):
    counts = {}
    for w in words:
        p = f"^^{w}$"
        for k in range(len(p) - 2):
            counts[p[k : k + 3]] = counts.get(p[k : k + 3], 0) + 1
    return x.CharModel(counts)


def test_viterbi_is_the_cheapest_path():
    rng = random.Random(1)
    m = model(["idiot", "ideal", "trash", "total", "ill", "lose", "loser"] * 5)
    for _ in range(150):
        token = "".join(rng.choice("idlot10$.-ae3") for _ in range(rng.randint(1, 6)))
        best = math.inf
        options = []
        for k, c in enumerate(token):
            o = [(y, x.OTHER) for y in x.LEET.get(c, "")]
            if c.isalpha() or (not o and c not in x.BETWEEN):
                o.append((c, 0.0))
            if k and token[k - 1] == c:
                o.append(("", x.REPEATED))
            elif c in x.BETWEEN:
                o.append(("", x.LEFT_OUT))
            options.append(o)
        for path in itertools.product(*options):
            text = "^^" + "".join(c for c, _ in path) + "$"
            cost = sum(p for _, p in path) + sum(m.cost(text[k : k + 2], text[k + 2]) for k in range(len(text) - 2))
            if cost < best - 1e-9:
                best, want = cost, text[2:-1]
        got = m.restore(token)
        text = "^^" + got + "$"
        assert got == want or abs(sum(m.cost(text[k : k + 2], text[k + 2]) for k in range(len(text) - 2)) - sum(m.cost(f"^^{want}$"[k : k + 2], f"^^{want}$"[k + 2]) for k in range(len(want) + 1))) < 3


def test_hidden_words_are_restored():
    m = model(["idiot", "stupid", "moron", "hello", "the", "and"] * 20)
    for token in ("1d10t", "i.d.i.o.t", "iiidiot", "id!ot", "idiot!!", "(idiot)", "i-d-i-o-t"):
        assert x.restored(token, m) == "idiot"
    assert x.restored("hello", m) == "hello" and x.restored("2024", m) == "2024"
    assert "i d i o t" in x.tokens_of("you I d I o t now") and x.tokens_of("s t u p i d") == {"s t u p i d"}
    assert x.tokens_of("a b cd e f g\n h ij") == {"a", "b", "cd", "e f g h", "ij"}
    assert x.tokens_of(None) == set() == x.tokens_of(" \n")


def test_every_lattice_of_several_paths_is_searched():
    m = model(["idiot", "stupid", "moron", "scum", "trash", "loser", "ass", "hello", "the", "and"] * 20)
    for token, word in (("moorron", "moron"), ("idiiot", "idiot"), ("sccum", "scum"), ("scuum", "scum"), ("traash", "trash"), ("losser", "loser"), ("455", "ass"), ("1d10t!", "idiot")):
        assert x.restored(token, m) == word
    for token, word in (("a$$", "ass"), ("@$$", "ass"), ("!diot", "idiot"), ("|diot!", "idiot"), ("a$$!", "ass"), ("!!|diot", "idiot"), ("s(um", "scum"), ("(um", "cum"), ("hello", "hello"), ("(hello)", "hello")):
        assert word in x.readings(token, m)
    assert x.readings("--", m) == set() and x.readings("2024", m) == {"2024"}


def test_a_spaced_run_is_a_lattice_of_words():
    """Words and spaces as the cheapest path has them, under the model of a whole table with the words in it."""
    rows = [w for r in DOCS for w in r.lower().split() if w.isalpha()]
    m = model(rows + ["poop", "ass", "you", "are", "an"] * (len(rows) // 2000))
    for run, words in (("y o u i d i o t", {"you", "idiot"}), ("p o o p", {"poop"}), ("a s s", {"ass"}), ("1 d 1 0 t", {"idiot"}), ("s c u m", {"scum"}), ("$ t u p 1 d", {"stupid"}), ("t r a s h", {"trash"}), ("w o r t h l e s s", {"worthless"})):
        assert x.tokens_of(run) == {run}
        whole = m.restore(run.replace(" ", ""))
        assert set(m.restore(run).split(" ")) | {whole} <= x.readings(run, m)
        assert all(any(w in r for r in x.readings(run, m)) for w in words), (run, x.readings(run, m))
    assert x.readings("1337", m) and all(w.isalpha() for w in x.readings("1337", m))


def test_doubled_letters_by_themselves_or_by_search():
    m = model(["idiot", "ideal", "loser", "summer", "assess", "trash"] * 9)
    rng = random.Random(2)
    search = x.CharModel(m.tri)
    search._doubles = lambda token: None
    for _ in range(800):
        token = "".join(c * rng.choice((1, 1, 1, 2, 2, 3)) for c in (rng.choice("aeidlmorstu") for _ in range(rng.randint(1, 9))))
        assert m.restore(token) == search.restore(token), token


def test_spaced_runs_like_brute_force():
    m = model(["idiot", "you", "a", "to", "do", "it"] * 9)
    rng = random.Random(6)
    for _ in range(60):
        letters = [rng.choice("idotyu01a") for _ in range(rng.randint(3, 5))]
        best = math.inf
        for chosen in itertools.product(*[[(o, x.OTHER) for o in x.LEET.get(c, "")] + ([(c, 0.0)] if c.isalpha() else []) + ([("", x.REPEATED)] if k and letters[k - 1] == c else []) for k, c in enumerate(letters)]):
            for gaps in itertools.product([True, False], repeat=len(letters) - 1):
                words, cost = [""], sum(p for _, p in chosen) + sum(x.ENDED if g else x.JOINED for g in gaps)
                for k, (c, _) in enumerate(chosen):
                    words[-1] += c
                    if k < len(gaps) and gaps[k]:
                        words.append("")
                if "" in words:
                    continue
                for w in words:
                    p = f"^^{w}$"
                    cost += sum(m.cost(p[k : k + 2], p[k + 2]) for k in range(len(p) - 2))
                if cost < best - 1e-9:
                    best, want = cost, " ".join(words)
        assert m.restore(" ".join(letters)) == want


def test_long_tokens_take_linear_time():
    m = model(["idiot", "the"] * 9)
    for token in ("a" * 300_000, "1" * 300_000, "." * 300_000 + "a" + "." * 300_000 + "a", " ".join("a" * 200_000), "a1!" * 100_000):
        begin = time.process_time()
        x.readings(token, m)
        assert time.process_time() - begin < 20


PLANTED = ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron")


def hide(text, rng):
    """The planted words of a text in leetspeak, with repeated letters, with marks or with blanks between letters."""
    leet = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}

    def other(m):
        word = m.group()
        kind = rng.randrange(4)
        if kind == 0:
            return "".join(leet.get(c.lower(), c) if rng.random() < 0.6 else c for c in word)
        if kind == 1:
            at = rng.randrange(len(word))
            return word[:at] + word[at] * rng.randint(2, 4) + word[at + 1 :]
        return rng.choice(".-*_").join(word) if kind == 2 else " ".join(word)

    return re.sub("|".join(PLANTED), other, text, flags=re.I)


def test_held_out_accuracy(spark):
    """Of held-out documents, and of copies of the toxic ones with their words hidden, which no label knows."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(3)
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").filter("crc32(cast(doc_id AS string)) % 5 = 0").select("doc_id", "text").collect()
    hidden = [(10_000_000 + r["doc_id"], hide(r["text"], rng)) for r in toxic if re.search("|".join(PLANTED), r["text"], re.I)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(hidden, "doc_id long, text string"))
    scores = {r["doc_id"]: r for r in x.score_documents(every, labels).collect()}
    rows = [(scores[r["doc_id"]], r["toxic"]) for r in labels.filter("crc32(cast(doc_id AS string)) % 5 = 0").collect() if r["doc_id"] in scores]
    pos, neg = [r["score"] for r, t in rows if t], [r["score"] for r, t in rows if not t]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > 0.95
    assert sum(p >= 0.5 for p in pos) >= 0.9 * len(pos) and sum(n >= 0.5 for n in neg) <= 0.02 * len(neg)
    assert len(hidden) > 50 and sum(scores[i]["predicted"] for i, _ in hidden) >= 0.95 * len(hidden)


def test_held_out_labels_are_never_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(x.score_documents(docs, labels)) == key(x.score_documents(docs, flipped))
    for r in x.score_documents(docs, labels).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None, "s"), (1, None, "s"), (None, "a 1d10t", "s"), (3, "", "s"), (4, "x" * 200000, "s")]).selectExpr("*", "1 as score", "2 as label", "3 as part")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = x.score_documents(docs, empty).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 0.5 for r in got)
    assert x.score_documents(make_docs([]), empty).count() == 0
    some = spark.createDataFrame([(1, 0, 1), (3, 0, None), (4, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert x.score_documents(docs, some).count() == 5
