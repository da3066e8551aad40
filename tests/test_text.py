import difflib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.functions import udfs

ODD = ["", " ", "a", " a  b ", "\t\x1c x y  ", "\x85z\x0b", "x　", "​q​", "tab\tnew\nline", "år7 arbete15 ab123, ab1234 x1.", "a – b — c"]


def column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_whitespace_is_pythons(spark):
    assert column(spark, ODD, tx.strip) == [v.strip() for v in ODD]
    assert column(spark, ODD, tx.norm) == [re.sub(r"\s+", " ", v).strip() for v in ODD]
    assert column(spark, ODD, tx.split_words) == [v.split() for v in ODD]
    assert column(spark, ODD, tx.is_blank) == [not v.strip() for v in ODD]
    assert column(spark, [None, *ODD], tx.norm_box) == [re.sub(r"\s+", "", v or "").replace("–", "-").replace("—", "-") for v in [None, *ODD]]


def test_clean_pdf_and_fences(spark):
    want = [re.sub(r"(?<=[a-zA-Z])\d{1,3}\b", "", v).strip() for v in ODD]
    assert column(spark, ODD, tx.clean_pdf) == want
    replies = ["```json\n[1]\n```", "```\n[1]```  ", " [1] ", "```json[1]", "text ``` text"]
    assert column(spark, replies, tx.clean_fences) == ["[1]", "[1]", " [1] ", "[1]", "text ``` text"]


def test_names_and_suffixes(spark):
    paths = ["a.docx", "/x.y/b.PDF", "/x.y/c", ".hidden", "d.tar.gz", "e."]
    assert column(spark, paths, tx.suffix) == [".docx", ".pdf", "", "", ".gz", "."]
    assert column(spark, ["a.docx", "b", "c.d.pdf"], tx.output_name) == ["a_klarspråkad.docx", "b_klarspråkad", "c.d_klarspråkad.pdf"]


def test_json_length_like_python(spark):
    import json

    values = ["plain", 'quo"te', "back\\slash", "new\nline", "åäö", "tab\t"]
    got = column(spark, values, lambda v: tx.json_length({"type": F.lit("paragraph"), "text": v, "empty": F.lit(False), "none": F.lit(None).cast("string")}))
    assert got == [len(json.dumps({"type": "paragraph", "text": v, "empty": False}, ensure_ascii=False)) for v in values]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


short = st.text(alphabet="ab cé", max_size=30)


@given(short, short)
def test_lcs_and_ratio(a, b):
    assert udfs.lcs_length(a, b) == lcs(a, b)
    r = udfs.ratio(a, b)
    assert r == udfs.ratio(b, a) and 0 <= r <= 100 and udfs.ratio(a, a) == 100


words = st.lists(st.sampled_from(["the", "then", "cat", "cats", "a", "plain", "plane", "x"]), max_size=25).map(" ".join)


@settings(max_examples=200)
@given(words, words)
def test_word_diff_round_trip_and_difflib(a, b):
    segments = udfs.ndiff_words(a, b)
    pick = lambda *kinds: [v.strip() for _, k, v in segments if k in kinds]
    assert pick("text", "strike") == a.split() and pick("text", "insert") == b.split()
    lines = [x for x in difflib.ndiff(a.split(), b.split()) if x[:2] != "? "]
    assert [v for _, _, v in segments] == [x[2:] + " " for x in lines]


@settings(max_examples=15, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(65, 110), st.integers(65, 110))
def test_word_diff_of_large_blocks_equals_difflib(r, n, m):
    """Replaced blocks of more than 4,096 pairs of words."""
    word = lambda side: r.choice(["alpha", "alpine", "beta", "gamma", "plane"]) + r.choice("xyz") * r.randrange(3) + side * r.randrange(2)
    a, b = [word("1") for _ in range(n)], [word("2") for _ in range(m)]
    lines = [x for x in difflib.ndiff(a, b) if x[:2] != "? "]
    assert [v for _, _, v in udfs.ndiff_words(" ".join(a), " ".join(b))] == [x[2:] + " " for x in lines]


def test_word_diff_of_seventy_near_words():
    a, b = [f"alpha{k}" for k in range(70)], [f"alpha{k}x" for k in range(70)]
    want = [({"- ": "strike", "+ ": "insert", "  ": "text"}[x[:2]], x[2:] + " ") for x in difflib.ndiff(a, b) if x[:2] != "? "]
    assert [(k, v) for _, k, v in udfs.ndiff_words(" ".join(a), " ".join(b))] == want


def test_replace_once():
    assert udfs.replace_once("a b a", "a", "x") == "x b a"
    assert udfs.replace_once("see a \n b here", "a b", r"\1 c") == r"see \1 c here"
    assert udfs.replace_once("unrelated", "other", "new") == "new" and udfs.replace_once("t", "", "new") == "new"


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a b", "a c"), (None, None)], "old string, new string")
    rows = df.select(udfs.similarity("old", "new").alias("s"), udfs.word_diff("old", "new").alias("d")).collect()
    assert [r["s"] for r in rows] == [0, 0, 67, 0] and [len(r["d"]) for r in rows] == [1, 1, 3, 0]
