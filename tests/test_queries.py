"""Every query with SQL gives the SQL's rows."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NATIVE = entry.native.QUERIES


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(values):
    return sorted((tuple(float(v) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_same_as_sql(spark, sf_dir, sql, name):
    found = NATIVE[name](spark, sf_dir)
    columns = sorted(found.columns)
    asked = sql.execute(f"SELECT {', '.join(columns)} FROM ({entry.ORACLES[name]})")
    assert rows(tuple(r) for r in found.select(columns).collect()) == rows(asked.fetchall())


def test_all_have_sql():
    assert NATIVE.keys() == entry.ORACLES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_a_library_of_the_llm_part():
    """Where a library of the training-data operators is missing, all other queries are there."""
    code = """
import sys
sys.modules["ahocorasick"] = None
import __spark_entry__ as entry
print(len(entry.queries()) == len(entry.native.QUERIES) == sum(k.startswith("q") for k in entry.queries()), len(entry.oracle_sql()) == len(entry.ORACLES))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=ROOT)
    assert done.stdout.split() == ["True", "True"], done.stderr[-2000:]
