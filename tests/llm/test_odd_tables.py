"""Every operator over tables with nulls everywhere, repeated rows, very long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontam, mixing, ngram_join, pii, quality_rules, secrets, sharding, toxicity, url_filters, warc

CLASHES = "shard slot size taken target weight n_words kept base found spans blob findings content node component a b unit text_crc32 items removal record digest value refers_to host path rule verdict href page score label part features".split()
LONG = "word " * 60_000 + "é" * 300_000


@pytest.fixture(scope="module")
def docs(make_docs):
    rows = [(None, None, None), (None, None, None), (1, None, "a"), (1, None, "a"), (2, "", None), (3, LONG, "b"), (3, LONG, "b"), (4, " \n\t", "b"), (5, "mail a@b.co token = abcdef12 the end of it", "c")]
    return make_docs(rows).select("*", *[F.lit(1).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(None, None, None), (None, None, None), (1, "http://x.com/de/", LONG), (2, "http://y.com/", LONG), (2, "http://y.com/", LONG), (3, "no address", ""), (4, "", "<link rel=canonical href='http://x.com/de/'>"), (5, "http://z.com/", "<link rel=canonical href='http://x.com/de/'>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in CLASHES])


def test_documents(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 0), (5, None, None), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "the end of it"), (2, "the end of it")], "item_id long, text string")
    n = docs.count()
    assert sharding.shard_documents(docs, 3).count() == n
    assert quality_rules.judge(docs, labels).count() == n
    assert mixing.mix_documents(docs).count() == n
    assert {r["doc_id"]: r["spans"] for r in pii.digest(docs).collect()}[5] == "email:5:11"
    assert {r["doc_id"]: r["n_assign"] for r in secrets.digest(docs).collect()}[5] == 1 and secrets.digest(docs).count() == n
    linked = ngram_join.link(docs).collect()
    assert len(linked) == n and all(r["component_id"] == r["doc_id"] for r in linked)
    assert toxicity.score_documents(docs, labels).count() == n
    hit = {r["doc_id"]: r["n_hit"] for r in decontam.contamination(docs, bench).collect()}
    assert hit[5] == 4 and sum(hit.values()) == 4
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == n - 1


def test_pages(pages):
    judged = url_filters.judge_pages(pages)
    assert judged.count() == pages.count()
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {None: "allow", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"}
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=repr)
    assert got == sorted([(None, "response", None), (None, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None)], key=repr)
