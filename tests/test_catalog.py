"""Every query with SQL equals DuckDB's answer at the smallest scale; the others run and return rows."""

import os

import duckdb
import pytest

from recollect.catalog import ORACLE, QUERIES
from tests.compare import same_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE:
        wanted = duck.execute(ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert same_rows(found, wanted)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "recollect")
    for folder, _, files in os.walk(root):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert "recollect.llm" not in open(os.path.join(folder, f)).read()
