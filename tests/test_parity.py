"""Every registered query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, order):
    return sorted([tuple(str(float(r[i])) if isinstance(r[i], (int, float)) else str(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_parity(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    con = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in con.description]
    assert sorted(cols) == sorted(df.columns)
    names = sorted(cols)
    assert plain(df.collect(), [df.columns.index(c) for c in names]) == plain(con.fetchall(), [cols.index(c) for c in names])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
