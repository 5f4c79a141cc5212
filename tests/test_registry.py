"""Every registered query gives the rows of its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from evispark.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


def _key(row):
    return tuple((x is not None, f"{x:.7g}" if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted(_key([r[c] for c in columns]) for r in frame.collect())
    if name not in registry.ORACLE_SQL:
        assert columns
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted(_key([r[i] for i in place]) for r in found.fetchall())
