from collections import defaultdict

from quillmill.llm import mixing


def fill(sizes, weights, share, cap):
    """Clamp and reshare until feasible."""
    total, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if total * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = total * weights[i] / w
            break
        for i in over:
            targets[i] = cap * sizes[i]
            total -= targets[i]
        open_ -= over
    return targets


def test_targets_and_taken(spark, make_docs):
    rows = [(i, "w " * (i % 40), f"src{i % 7}" if i % 11 else None) for i in range(600)] + [(1, "a b c", "big")] * 3 + [(None, None, "z")] + [(9000 + i, "w " * 50, "big") for i in range(400)]
    got = mixing.mix_documents(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, t in zip(names, want):
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(names)


def test_many_sources_over_many_ranges(spark):
    rows = [(f"s{i:04d}", (i * 37) % 101 + 1) for i in range(700)]
    df = spark.createDataFrame(rows, "__qm_src string, source_size long").repartition(9)
    out = mixing.numbered(df, "__qm_src")
    got = {r["__qm_src"]: r["__qm_pos"] for r in out.collect()}
    assert got == {s: k for k, (s, _) in enumerate(rows)}
    for share in (0.3, 1.5, 1.99, 2.0, 3.0):
        filled = mixing.water_fill(out.selectExpr("*", "__qm_pos % 3 + 1 as weight"), share).orderBy("__qm_src").collect()
        want = fill([n for _, n in rows], [k % 3 + 1 for k in range(700)], share, 2)
        assert all(abs(r["target"] - t) < 1e-6 * t for r, t in zip(filled, want))


def test_empty_and_wordless(spark, make_docs):
    assert mixing.mix_documents(make_docs([])).count() == 0
    got = mixing.mix_documents(make_docs([(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_repetitions_keep_columns(spark, make_docs):
    docs = make_docs([(i, "a b c d " * (1 + i % 5), f"s{i % 3}") for i in range(300)]).selectExpr("*", "1 as size", "2 as taken")
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    words = out.selectExpr("sum(size(split(trim(text), ' '))) as n").first()["n"]
    have = docs.selectExpr("sum(size(split(trim(text), ' '))) as n").first()["n"]
    assert abs(words - 1.5 * have) < 30 * 3
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 2
