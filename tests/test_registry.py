"""Each registered query of the linkage engine against its SQL oracle."""

import duckdb
import pytest

from tessera.plans import registry

DIR = "/root/testdata/sf0.001"


def same(v):
    if v is None or v != v:
        return "~"
    return repr(round(v, 7) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    rows, columns = df.collect(), sorted(df.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(same(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert sorted(tuple(same(r[c]) for c in columns) for r in rows) == want
