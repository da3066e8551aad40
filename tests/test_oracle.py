"""Every query with SQL against DuckDB on the smallest tables."""

import datetime

import duckdb
import pytest

from quillmill.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return ("f", round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(q.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(q.QUERIES) <= set(e.queries())
