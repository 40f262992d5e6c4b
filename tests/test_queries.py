"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from brindle.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    left = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert left == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
