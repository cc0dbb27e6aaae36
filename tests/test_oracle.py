"""Every query with an SQL counterpart gives the same rows as DuckDB."""

import duckdb
import pytest

from tracklake import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    def value(x):
        return None if x is None or x != x else round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    expected = duck.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(tuple(r) for r in found.select(*names).collect()) == rows(expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
