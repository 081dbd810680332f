"""The operators that SQL can express, against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from tallybrook.llm.queries import oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = c.execute(oracle_sql()[name])
    theirs = [d[0] for d in got.description]
    frame = queries()[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(theirs)
    assert sorted(map(str, (tuple(r) for r in frame.select(*theirs).collect()))) == sorted(map(str, got.fetchall()))
