"""Every query with a DuckDB twin gives the same rows at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(plain(row[c]) for c in order) for row in rows)
    theirs = sorted(tuple(plain(x[names.index(c)]) for c in order) for x in r.fetchall())
    assert ours == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["grp", "end", "kmer", "terminal_count", "fold_enrichment", "anchored", "rank"] and df.count() > 0
