"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

from hornlake import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 9)


def rows(table, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table), key=str)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_twin(spark, duck, name):
    df = engine.QUERIES[name](spark, DATA)
    found = [r.asDict() for r in df.collect()]
    if name not in engine.SQL:
        assert found
        return
    result = duck.execute(engine.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    columns.sort()
    assert rows(found, columns) == rows(expected, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
