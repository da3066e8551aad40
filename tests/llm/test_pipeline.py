import re
from collections import Counter

import corpus_pipeline as p
from quillmill.llm import quality_rules
from tests.llm.test_decontam import brute as hits
from tests.llm.test_ngram_join import brute as components


def test_every_stage(spark, sf):
    """Each stage over its predecessor's rows, against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    columns, texts = docs.columns, lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    key = lambda df: sorted(map(tuple, df.collect()))

    first = p.quality(spark, docs, sf)
    verdicts = quality_rules.judge(docs, labels).filter("kept")
    assert first.columns == columns and key(first) == key(docs.join(verdicts.select("doc_id"), "doc_id", "left_semi").select(columns))

    rows = sorted(texts(first).items())
    want = {i for i, _, c in components(rows, 5, 80, 100) if i == c}
    second = p.near_duplicates(spark, first, sf)
    assert second.columns == columns and set(texts(second)) == want

    kept = sorted(texts(second).items())
    bad = {r[0] for r in hits(kept, [(r["item_id"], r["text"]) for r in bench.collect()]) if r[-1]}
    third = p.benchmark_passages(spark, second, sf)
    assert bad and third.columns == columns and key(third) == key(second.filter(~second["doc_id"].isin(*bad)))

    fourth = p.mix(spark, third, sf)
    assert fourth.columns == columns
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert max(Counter(r["doc_id"] for r in fourth.collect()).values()) <= 2
    assert abs(size(fourth) - 1.5 * size(third)) < 0.25 * size(third)

    last = p.shard(spark, fourth, sf)
    counts = Counter(r["shard"] for r in last.collect())
    assert key(last.select(columns)) == key(fourth) and max(counts.values()) - min(counts.values()) <= 1


def test_run_gives_all_stages(spark, sf):
    out = p.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() > 100


def test_empty_and_odd_documents(spark, make_docs, sf):
    odd = make_docs([(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 100000, "b")]).selectExpr("*", "1 as n_words", "2 as kept", "3 as node", "4 as size", "5 as cell")
    for docs in (odd, make_docs([])):
        for _, stage in p.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            assert stage(spark, docs, sf).count() <= 2 * docs.count()
        assert p.shard(spark, docs, sf).count() == docs.count()
