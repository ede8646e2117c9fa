"""Every query runs on the smallest tables, and agrees with its SQL where there is any."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in entry.TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: float(v) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(entry.plans.QUERIES))
def test_query(spark, duck, name):
    df = entry.plans.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in entry.plans.SQL:
        want = duck.sql(entry.plans.SQL[name])
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_import_needs_no_session():
    """The entry is imported before a session is made."""
    import subprocess
    import sys

    at = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=at, check=True, timeout=120)
