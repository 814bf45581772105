"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import difflib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns
    df.collect()


def test_near_duplicates_are_whole(spark, small):
    """The query that SQL can't express, against every pair of the table."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", T.trigrams(F.left("text", F.lit(500))).alias("g")).where("length(text) >= 20").collect()
    sets = [(r.doc_id, r.text[:500], set(r.g)) for r in rows if r.g]
    near = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :] if len(a[2] & b[2]) / len(a[2] | b[2]) >= 0.35]
    want = {(min(a[0], b[0]), max(a[0], b[0]), round(x, 4)) for a, b in near if (x := difflib.SequenceMatcher(None, *(t for _, t, _ in sorted([a, b], key=lambda v: v[0]))).ratio()) >= 0.92}
    got = QUERIES["near_duplicate_threads"](spark, small).collect()
    assert want and {(r.left_key, r.right_key, r.similarity) for r in got} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
