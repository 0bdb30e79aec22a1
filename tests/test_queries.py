import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from gradeloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return c


def _plain(v):
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v + 0.0 if isinstance(v, float) else v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def test_entry_gives_rows(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", catalog.SQL)
def test_query_equals_its_sql(spark, db, name):
    df = e.queries()[name](spark, SMALL)
    cursor = db.execute(e.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(_plain(x) for x in r) for r in cursor.fetchall()]
    got = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL and n != "kmeans_profile"])
def test_query_without_sql_gives_rows(spark, name):
    assert e.queries()[name](spark, SMALL).count() > 0
