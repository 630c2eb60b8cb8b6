"""Every query with SQL gives what DuckDB gives over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from atrium.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = "part lineitem events pages supplier".split()


LARGER = {"f5_room_area": "/root/testdata/sf0.01"}  # rooms are small in the smallest tables


def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    folder = LARGER.get(name, DATA)
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got
    if name in ORACLE_SQL:
        r = duck(folder).sql(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert plain(got) == plain(tuple(x[names.index(c)] for c in cols) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
