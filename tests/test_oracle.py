"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from glyphmill import queries as core

DATA = "/root/testdata/sf0.001"
NAMES = sorted(core.oracle_sql())


def normal(rows):
    return sorted(str([f"{v:.7g}" if isinstance(v, float) else str(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = core.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = db.execute(core.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert normal(tuple(r) for r in df.select(*columns).collect()) == normal(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "rank"
    assert set(entry.oracle_sql()) <= set(entry.queries())
