import random
import zlib
from collections import Counter

from quillmill.llm import sharding


def test_counts_slots_and_checksums(spark, make_docs):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7) + "x" * (i % 300), "s") for i in range(1000)] + [(None, "n", "s")] * 3 + [(7, "same", "s")] * 5
    got = sharding.shard_documents(make_docs(rows), 24).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_repeated_and_missing_keys_are_spread(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).alias("doc_id"), F.col("id").alias("size"))
    cells = df.groupBy(sharding.cell_of(F.col("doc_id"), tie=[F.col("size")])).count().agg(F.max("count")).first()[0]
    assert cells < 10
    a, b = (sorted(map(tuple, sharding.assign(df, "doc_id", 24, [F.col("size")]).collect()), key=repr) for _ in range(2))
    assert a == b and len({r[2] for r in a}) == 24


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert sharding.shard_documents(make_docs([]), 24).count() == 0
    df = make_docs([(i, "t", "s") for i in range(50)]).selectExpr("*", "doc_id as shard", "1 as cell", "2 as lo", "3 as base", "4 as rank")
    out = sharding.assign(df, "doc_id", 4)
    assert out.count() == 50 and out.filter("cell = 1 and lo = 2 and base = 3 and rank = 4").count() == 50


def brute(counts, points, capacity):
    """Key by key: every waiting key moves one open point a round."""
    room, home = list(capacity), {}
    keys = [(c, k) for c in sorted(counts) for k in range(counts[c])]
    at = {key: next((i for i, (c, _) in enumerate(points) if c >= key[0]), 0) for key in keys}
    pending = keys
    while pending:
        left = []
        order = {k: i for i, k in enumerate(pending)}
        for key in sorted(pending, key=lambda k: (at[k], order[k])):
            s = points[at[key]][1]
            if room[s]:
                room[s] -= 1
                home[key] = s
            else:
                left.append(key)
        for key in left:
            at[key] = (at[key] + 1) % len(points)
            while not room[points[at[key]][1]]:
                at[key] = (at[key] + 1) % len(points)
        pending = left
    return home


def test_overflow_like_key_by_key():
    rng = random.Random(1)
    for _ in range(20):
        shards = rng.randint(1, 5)
        points = sharding.ring(shards, 4, 6)
        counts = {rng.randrange(64): rng.randint(1, 30) for _ in range(20)}
        capacity = sharding.capacities(sum(counts.values()), shards)
        if {s for _, s in points} != set(range(shards)):
            continue
        got = {(p["cell"], k): p["shard"] for p in sharding.place(counts, points, capacity) for k in range(p["lo"], p["hi"])}
        assert Counter(got.values()) == Counter({s: c for s, c in enumerate(capacity) if c})
        assert got == brute(counts, points, capacity)


def test_growth_moves_little(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    a = sharding.assign(df, "doc_id", 24).withColumnRenamed("shard", "a").drop("slot")
    b = sharding.assign(df, "doc_id", 25).withColumnRenamed("shard", "b").drop("slot")
    assert a.join(b, "doc_id").filter("a <> b").count() < 0.25 * 20000


def test_bounded_load_with_slack(spark):
    out = sharding.assign(spark.range(5000).withColumnRenamed("id", "doc_id"), "doc_id", 10, epsilon=0.1)
    assert max(r["count"] for r in out.groupBy("shard").count().collect()) <= 550
