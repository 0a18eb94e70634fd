"""Helpers of the tests."""

import duckdb


def same_as_sql(df, sql: str, sf_dir: str) -> None:
    """Compare a query's rows with those of its SQL over the tables of sf_dir."""
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
