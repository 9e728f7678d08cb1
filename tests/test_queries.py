"""Every core query with SQL gives the rows of that SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
CORE = {k: v for k, v in entry_points.queries().items() if k.startswith(("q", "p5_"))}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(names, rows, columns):
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = rows_of(df.columns, df.collect(), columns)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == rows_of(names, found.fetchall(), columns)
