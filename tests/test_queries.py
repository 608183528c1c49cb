"""Every registered query that has SQL against it, on the smallest tables."""

import os

import pytest

from vistaq.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(x):
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return "" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, SF)
    rows = [[plain(v) for v in r] for r in got.select(sorted(got.columns)).collect()]
    if name not in queries.SQL:
        assert rows
        return
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(rows) == sorted([plain(v) for v in r] for r in want.select(columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
