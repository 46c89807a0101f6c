"""Every query with SQL gives the rows that DuckDB gives."""
import os

import duckdb
import pytest

from refsift.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    shown = lambda v: repr(round(float(v), 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_reruns_agree(spark, name):
    """Queries without SQL, which other tests hold against brute force: rows, and the same ones again in other partitions."""
    first = QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in first.collect()], first.columns)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = QUERIES[name](spark, DATA)
        assert got and got == rows([tuple(r) for r in again.collect()], again.columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
