"""Every registered query with SQL, against DuckDB on the same tables."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidefold.plans import catalog

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def normal(value):
    return round(value, 6) if isinstance(value, float) else None if value is None else str(value)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.sql("SET timezone = 'UTC'")
    for t in catalog.TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == cols
    want = sorted((tuple(map(normal, r)) for r in sql.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert sorted((tuple(map(normal, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr) == want


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    there = importlib.util.find_spec("tidefold.llm") is not None and os.path.exists(os.path.join(os.path.dirname(entry.__file__), "tidefold/llm/queries.py"))
    assert ("pipeline" in entry.queries()) == there
