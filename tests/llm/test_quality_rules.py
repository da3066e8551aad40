import math
import random
import re

from quillmill.llm import quality_rules as q


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(p + d for p in at for d in range(3))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def rows_of(df):
    return {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in df.collect()}


def texts():
    rng = random.Random(5)
    fixed = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a a", "x\x0by\x0cz\rw", "é ü # é ü # é ü #", "  a\nb\n\nb\n b", "w " * 70000]
    return fixed + ["".join(rng.choice("ab  \n#é") for _ in range(rng.randint(0, 200))) for _ in range(60)]


def test_statistics_like_brute_force(spark, make_docs):
    ts = texts()
    got = rows_of(q.statistics(make_docs([(i, t, "s") for i, t in enumerate(ts)])))
    assert got == {i: brute(t) for i, t in enumerate(ts)}


def test_clashing_hashes_do_not_count(spark, make_docs):
    """With hashes of two bits nearly all windows clash; the counts stay exact."""
    from pyspark.sql import functions as F

    from quillmill.llm.common import n_words, words

    ts = [t for t in texts() if t and len(t) < 5000] + ["u v w x y z u v w q", " ".join(f"w{k % 37}" for k in range(200))]
    df = make_docs([(i, t, "s") for i, t in enumerate(ts)])
    few = lambda *c: F.pmod(F.xxhash64(*c), F.lit(4)).cast("long")
    got = df.select("doc_id", words(df["text"]).alias("w"), n_words(df["text"]).alias("n")).select("doc_id", q.repeat_words(F.col("w"), F.col("n"), few).alias("r"))
    assert {r["doc_id"]: r["r"] for r in got.collect()} == {i: brute(t)[4] for i, t in enumerate(ts)}


def test_statistics_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(q.statistics(docs)) == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}


def covering(rows, features, bins=32, max_rules=8, max_conditions=4, min_precision=0.9, min_cover=5):
    """The decision list by plain loops. rows: (feature values, bad, prune)."""
    cuts = {}
    for f in features:
        values = sorted(x[f] for x, _, _ in rows)
        cuts[f] = sorted({values[max(0, math.ceil(i / bins * len(values)) - 1)] for i in range(1, bins)})
    holds = lambda x, rule: all((x[f] > t) if above else (x[f] <= t) for f, above, t in rule)
    rules = []
    for _ in range(max_rules):
        left = [r for r in rows if not any(holds(r[0], rule) for rule in rules)]
        rule = []
        for _ in range(max_conditions):
            inside = [(x, bad) for x, bad, prune in left if not prune and holds(x, rule)]
            p0, n0 = sum(b for _, b in inside), len(inside)
            best = None
            for f in features:
                for cut in cuts[f]:
                    for above in (False, True):
                        got = [b for x, b in inside if (x[f] > cut) == above]
                        if 0 < p0 < n0 and sum(got) >= min_cover and len(got) < n0 and (f, above, cut) not in rule:
                            gain = sum(got) * (math.log2(sum(got) / len(got)) - math.log2(p0 / n0))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, (f, above, cut))
            if best is None:
                break
            rule.append(best[1])
        if not rule:
            break
        pruning = [(x, bad) for x, bad, prune in left if prune]
        worth = []
        for k in range(len(rule)):
            got = [b for x, b in pruning if holds(x, rule[: k + 1])]
            worth.append(((2 * sum(got) - len(got)) / len(got) if got else -1.0, k))
        rule = rule[: max(worth)[1] + 1]
        scope = [(b, p) for x, b, p in left if holds(x, rule)]
        pruned = [b for b, p in scope if p]
        if len(scope) < min_cover or sum(b for b, _ in scope) < min_precision * len(scope) or (pruned and sum(pruned) < min_precision * len(pruned)):
            break
        centred = []
        for f, above, t in rule:
            low, high = [x[f] for x, _, _ in left if x[f] <= t], [x[f] for x, _, _ in left if x[f] > t]
            centred.append((f, above, (max(low) + min(high)) / 2 if low and high else t))
        rules.append(centred)
    return lambda x: any(holds(x, rule) for rule in rules), rules


def test_kept_like_brute_force(spark):
    """The query's verdicts against statistics and covering by plain loops."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r["doc_id"]: (r["text"] or "", r["p"]) for r in docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("p")).collect()}
    rows = {}
    for i, (t, _) in texts.items():
        n, chars, symbols, dup, repeat = brute(t)
        lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        per = lambda a, b: a / b if b else 0.0
        x = dict(n_words=float(n), mean_word=per(chars, n), symbol_rate=per(symbols, chars), upper_rate=per(len(re.findall("[A-Z]", t)), chars), bang_rate=per(t.count("!"), n), digit_rate=per(len(re.findall("[0-9]", t)), chars), dup_line_rate=per(dup, lines), repeat_rate=per(repeat, n))
        rows[i] = (x, n < 50 or 100 * repeat > 50 * n)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rejects, rules = covering([(rows[i][0], int(quality[i] == 0), texts[i][1]) for i in quality if not rows[i][1]], q.FEATURES)
    assert rules
    assert {r["doc_id"]: r["kept"] for r in q.judge(docs, labels).collect()} == {i: not failed and not rejects(x) for i, (x, failed) in rows.items()}


def test_rules_reject_what_labels_reject(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    # learn on one half of the labels, look at the other
    rows = q.judge(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    kept_good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    kept_bad = [r["kept"] for r in rows if r["quality"] == 0 and not r["base_failed"]]
    assert sum(kept_good) >= 0.97 * len(kept_good)
    assert sum(kept_bad) <= 0.1 * len(kept_bad)


def test_no_labels_no_rules(spark, make_docs):
    docs = make_docs([(1, "a b c " * 3, "s"), (2, " ".join(f"w{i}" for i in range(80)), "s"), (None, None, None)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["kept"] for r in q.judge(docs, empty).collect()} == {1: False, 2: True, None: False}
    assert q.judge(make_docs([]), empty).count() == 0


def test_list_is_one_expression(spark):
    rules = q.DecisionList([[q.Condition("n_words", True, 3.0), q.Condition("mean_word", False, 2.0)], [q.Condition("n_words", False, 1.0)]])
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (0.0, 9.0)], "n_words double, mean_word double")
    assert [r[0] for r in df.select(rules.rejects()).collect()] == [True, False, True]
    assert [r[0] for r in df.selectExpr(rules.sql()).collect()] == [False, True, False]
