"""Every registered query that has SQL gives the rows that DuckDB gives."""

import collections

import duckdb
import pytest

from codeloom.plans.oracles import oracle_sql
from codeloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("supplier", "part", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    theirs = collections.Counter(tuple(row[found.columns.index(c)] for c in columns) for row in found.fetchall())
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == theirs
