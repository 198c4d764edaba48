import math
import os

import duckdb
import pytest

from lantern import listing_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = sorted(tuple(map(plain, r)) for r in df.collect())
    if name in queries.ORACLE_SQL:
        found = duck.sql(queries.ORACLE_SQL[name])
        order = [list(found.columns).index(c) for c in df.columns]
        assert rows == sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    assert len(found.columns if name in queries.ORACLE_SQL else df.columns) == len(df.columns)
