"""The driver's contract: names, schemas and SQL of all queries on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEXTMILL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def shaped(df):
    df = df[sorted(df.columns)]
    def shape(v):
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 6) + 0.0)
        return repr(float(v)) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else repr(v)

    return sorted(tuple(map(shape, row)) for row in df.itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "tfidf", "cosine"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    ours, sql = entry.queries()[name](spark, DATA).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert shaped(ours) == shaped(sql)


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
