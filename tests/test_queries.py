"""Every query of the reference's operators against its SQL, on the smallest tables."""

import os
from pathlib import Path

import __spark_entry__
import duckdb
import pytest
from pairwright.plans import PLANS

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for p in PLANS for n in p.QUERIES]
SQL = {n: s for p in PLANS for n, s in p.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    rows = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(rows.columns)
    got = sorted((tuple(r) for r in rows.select(*columns).collect()), key=str)
    if name in SQL:
        quoted = ", ".join(f'"{c}"' for c in columns)
        want = sorted(duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall(), key=str)
        assert got == want
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
