"""Every query with SQL gives that SQL's rows over the smallest tables."""

import math
import os

import duckdb
import pytest

from docloom import queries, queries_files, queries_joins, queries_reading, queries_records, queries_shelf, queries_support

PARTS = (queries, queries_files, queries_records, queries_reading, queries_shelf, queries_support, queries_joins)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items() if k in part.ORACLE_SQL}
ORACLE_SQL = {k: v for part in PARTS for k, v in part.ORACLE_SQL.items()}
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
