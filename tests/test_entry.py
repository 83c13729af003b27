"""Driver contract at sf0.001: entry runs, every query with SQL equals DuckDB on the same tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(rows):
    return sorted(tuple("None" if v is None else str(v) for v in r) for r in rows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["user", "event", "block"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    cols = sorted(df.columns)
    got = _norm(df.select(*cols).collect())
    o = con.sql(sql)
    assert sorted(o.columns) == cols
    want = _norm(o.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(got) == len(want)
    assert hashlib.sha1(repr(got).encode()).digest() == hashlib.sha1(repr(want).encode()).digest()
