import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import TABLES, norm

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not QUERIES[n].__module__.startswith("quarterloom.llm")]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def check(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        at = {x[0]: i for i, x in enumerate(cur.description)}
        assert sorted(at) == cols
        assert got == sorted(tuple(norm(r[at[c]]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    check(spark, con, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
