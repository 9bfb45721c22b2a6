"""Tables replaced whole, cut short at every phase."""

import pytest
from pairwright.operators import prepare
from pairwright.sources import rewrite
from pyspark.sql import functions as F


class Cut(Exception):
    pass


@pytest.fixture
def place(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(k, "" if k % 3 == 0 else f"v{k}", [k]) for k in range(50)], "id int, v string, more array<int>").write.parquet(path)
    return path


def filled(rows):
    known = rows.select("id", F.lit("new").alias("v")).where("id % 6 = 0")
    return prepare.with_filled_blanks(rows, known, "id", ["v"])


def state(spark, path):
    return {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("phase,done", [("written", False), ("verified", True), ("moved", True), ("replaced", True)])
def test_cut_short(spark, place, phase, done):
    old = state(spark, place)
    want = {k: "new" if v == "" and k % 6 == 0 else v for k, v in old.items()}

    def stop(at):
        if at == phase:
            raise Cut

    with pytest.raises(Cut):
        rewrite.rewrite(spark, place, filled, rewrite.only_blanks_filled("id", ["v"]), after=stop)
    assert rewrite.recover(spark, place) == ("finished" if done else "undone")
    assert state(spark, place) == (want if done else old)
    assert rewrite.recover(spark, place) == "nothing" and state(spark, place) == (want if done else old)
    again = rewrite.rewrite(spark, place, filled, rewrite.only_blanks_filled("id", ["v"]))
    assert {r["id"]: r["v"] for r in again.collect()} == want


def test_previous_rows_stay(spark, place):
    before = rewrite.fingerprint(spark.read.parquet(place))
    rewrite.rewrite(spark, place, filled)
    assert rewrite.fingerprint(spark.read.parquet(f"{place}.previous")) == before != rewrite.fingerprint(spark.read.parquet(place))
    rewrite.rewrite(spark, place, filled, keep_previous=False)
    assert not rewrite.Files(spark, place).exists(f"{place}.previous")


@pytest.mark.parametrize("change", [lambda rows: rows.where("id > 1"), lambda rows: rows.withColumn("v", F.lit("x")), lambda rows: rows.unionByName(rows.limit(1))])
def test_changes_that_fail_their_check(spark, place, change):
    old = state(spark, place)
    with pytest.raises(ValueError):
        rewrite.rewrite(spark, place, change, rewrite.only_blanks_filled("id", ["v"]))
    assert state(spark, place) == old and rewrite.recover(spark, place) == "nothing"


def test_fingerprint(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    assert rewrite.fingerprint(rows) == rewrite.fingerprint(rows.repartition(9)) != rewrite.fingerprint(rows.where("id > 0"))
    assert rewrite.fingerprint(rows.limit(0)) == (0, 0)
