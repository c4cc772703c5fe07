"""Queries with SQL give the rows that DuckDB gives for it."""

import duckdb
import pytest

from quaestor.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, data)
    order = [got.columns.index(c) for c in want.columns]
    assert sorted(tuple(str(r[i]) for i in order) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
