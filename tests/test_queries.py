"""Every query of the library against its SQL, over the smallest tables."""

import duckdb
import pytest

from terrahac import oracle, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("customer", "lineitem", "orders", "events", "supplier"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert got == want
    assert want
