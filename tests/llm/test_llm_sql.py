"""The SQL of this subpackage's queries, over views of the Parquet files as the driver makes them, against the queries."""

import os
from pathlib import Path

import duckdb
import pytest
from pairwright.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    rows = queries.QUERIES[name](spark, FOLDER)
    names = sorted(rows.columns)
    got = sorted((tuple(r) for r in rows.select(*names).collect()), key=str)
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE[name]})").fetchall(), key=str)
    assert got == want and got
