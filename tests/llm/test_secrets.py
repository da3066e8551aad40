import hashlib
import random
import re
import time

import pytest

from quillmill.llm import secrets as s


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def join(spans):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def texts():
    rng = random.Random(3)
    parts = ["token", " = ", ":", '"', "abc123", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "deadbeefcafe", "password", "API_KEY", "apikey", "'", " ", "é", "=", "x", "Secret", "\u017fecret", "to\u212aen"]
    return [None, "", 'token = "' + "ab" * 20 + '" x', "AKIA" * 12] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(300)]


def test_base_like_brute_force():
    for t in texts():
        assert [x for x in s.scan_text(t or "") if x[1] < 3] == brute(t)


def test_query(spark, make_docs):
    ts = texts()
    rows = [(i, t, "s") for i, t in enumerate(ts)] + [(1000 + i, ts[2], "s") for i in range(50)] + [(None, ts[2], "s")]
    got = s.digest(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = ts[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] < 1000 else ts[2]
        want = brute(t)
        assert r["base_sha256"] == hashlib.sha256(join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert r["blob"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_tables_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: hashlib.sha256(join(brute(r["text"])).encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["base_sha256"] for r in s.digest(docs).collect()} == want


def test_added_kinds():
    t = "x ghp_" + "a1B2" * 9 + " AIza" + "A" * 35 + " xoxb-1234567890-abc\n-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"
    assert {s.KINDS[k] for _, k, _ in s.scan_text(t)} == {"github", "google", "slack", "private_key"}


def test_ledger_scans_only_the_unseen(spark, make_docs, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = make_docs([(1, "token = secretvalue1", "s"), (2, "plain", "s"), (3, "plain", "s")])
    s.digest(first, ledger).collect()
    entries = spark.read.parquet(ledger)
    assert entries.count() == 2
    second = make_docs([(4, "plain", "s"), (5, "token = secretvalue2", "s"), (6, "token = secretvalue1", "s")])
    got = {r["doc_id"]: r["n_assign"] for r in s.digest(second, ledger).collect()}
    assert got == {4: 0, 5: 1, 6: 1}
    assert spark.read.parquet(ledger).count() == 3
    s.update_ledger(second, "text", ledger, "other-rules")
    assert spark.read.parquet(ledger).count() == 6


def test_empty(spark, make_docs):
    assert s.digest(make_docs([])).count() == 0


N = 1_000_000


@pytest.mark.parametrize("text", ["-eyJ" * (N // 4), "eyJabcdefghij." * (N // 14), "password" + " " * N, "-xoxb-" * (N // 6), "ghp_" * (N // 4), "-----BEGIN " + "A" * N, "AKIA" * (N // 4), "ab" * (N // 2)], ids=lambda t: t[:9])
def test_time_grows_with_the_text_alone(text):
    begin = time.process_time()
    s.scan_text(text)
    assert time.process_time() - begin < 2


def test_web_tokens():
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTYifQ.abcdefgh-_12"
    assert [(k, b - a) for a, k, b in s.scan_text(f"x {token}, y") if k == 6] == [(6, len(token))]
    assert not [x for x in s.scan_text(f"_{token}") if x[1] == 6]
