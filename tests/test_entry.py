from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from workloads.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == list(__import__("presscan").ARTICLE_FIELDS)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {"stream_articles", "stream_entries"}))
def test_query_matches_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF_DIR)
    relation = tables.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in at)) for row in relation.fetchall())
