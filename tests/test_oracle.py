"""Every query with SQL gives the rows of that SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert a == b


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
