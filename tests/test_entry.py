"""The registry, and queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).columns[0] == "file_a"


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_rows_match_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(e.oracle_sql()[name])
    assert sorted(want.columns) == cols
    fix = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    got = sorted(str([fix(r[c]) for c in cols]) for r in df.collect())
    names = want.columns
    assert got == sorted(str([fix(r[names.index(c)]) for c in cols]) for r in want.fetchall())
