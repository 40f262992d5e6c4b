"""The queries that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from brindle.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(str(r[n]) for n in names) for r in got.collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.fetchall())
