"""Every named query with SQL gives what DuckDB gives, whatever the partitioning."""

import duckdb
import pytest

from grovewright.plans import inventory, queries  # noqa: F401  inventory registers more

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns
    if name not in queries.ORACLE_SQL:
        return
    got = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in df.columns) for r in got.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows) == want
