"""Queries with SQL give the SQL's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from folioflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_registered():
    assert queries.QUERIES.keys() <= entry.queries().keys() and len(queries.QUERIES) == 10
