import math

import duckdb
import pytest

from gyrolake.plans import catalog

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"  # of queries without SQL, which other tests hold against brute force
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert catalog.queries()[name](spark, SMALL).count() > 0
        return
    df = catalog.queries()[name](spark, SF)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    expected = sorted(([plain(v) for v in (dict(zip(columns, r, strict=True))[c] for c in order)] for r in want.fetchall()), key=str)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=str)
    assert got and got == expected
