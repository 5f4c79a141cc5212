"""Queries with SQL give its rows, on the smallest tables."""

import duckdb
import pytest

from evispark.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    found = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(tuple(r[c] for c in names) for r in frame.collect()) == sorted(found.fetchall())
