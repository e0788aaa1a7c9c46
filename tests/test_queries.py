"""Every query of the library against its SQL, on the smallest tables, as multisets of rows; without SQL, that it runs."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from nestflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return round(float(x), 5) + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in catalog.ORACLE:
        assert got
        return
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    want = sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and abs(x - y) < 2e-5 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["obs", "support"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
