"""Adding by key: once, restartable, and reading no more as the table grows."""

import pytest
from pairwright.sources.registry import Registry


def rows(spark, ids, tag="x"):
    return spark.createDataFrame([(i, f"{tag}{i}") for i in ids], "id bigint, v string")


def ids(registry):
    return sorted(r["id"] for r in registry.rows().collect())


def test_each_key_once(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "t"), "id", buckets=4, full=50)
    r.add(rows(spark, [1, 2, 2, 3]), "a")
    r.add(rows(spark, [3, 4]), "b")
    r.add(rows(spark, [9, 10]), "a")  # the batch is there already
    assert ids(r) == [1, 2, 3, 4]
    r.add(rows(spark, []), "c")
    r.add(spark.createDataFrame([(None, "n"), (5, "x")], "id bigint, v string"), "d")
    r.add(spark.createDataFrame([(None, "again"), (5, "x")], "id bigint, v string"), "e")
    assert sorted(r.rows().collect(), key=str)[-1]["v"] == "n" and r.rows().count() == 6
    with pytest.raises(ValueError):
        r.add(rows(spark, [1]), "../x")


@pytest.mark.parametrize("broken", ["rows", "keys"])
def test_restart_of_a_batch_cut_short(spark, tmp_path, monkeypatch, broken):
    r = Registry(spark, str(tmp_path / "t"), "id", buckets=2)
    r.add(rows(spark, range(10)), 0)
    mark = r.files.mark
    hold = lambda *a: (_ for _ in ()).throw(RuntimeError("cut"))
    monkeypatch.setattr(r.files, "mark", hold) if broken == "keys" else monkeypatch.setattr(r, "_hashed", lambda rows, n, f=r._hashed, calls=[]: hold() if calls.append(1) or len(calls) > 1 else f(rows, n))
    with pytest.raises(RuntimeError):
        r.add(rows(spark, range(5, 15)), 1)
    monkeypatch.undo()
    r.files.mark = mark
    assert ids(r) == list(range(10))  # what was half done is not read
    r.add(rows(spark, range(5, 15)), 1)
    r.add(rows(spark, range(14, 20)), 2)
    assert ids(r) == list(range(20))


def test_reads_stay_flat(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "t"), "id", buckets=4, full=40)
    read, buckets = [], set()
    for batch in range(12):
        fresh = r._hashed(rows(spark, range(batch * 60, batch * 60 + 3)), r._current()[1])
        read.append(r.known(fresh, "new").count())
        buckets.add(r._current()[1])
        r.add(rows(spark, range(batch * 60, batch * 60 + 60)), batch)
    assert ids(r) == list(range(720))
    assert len(buckets) > 2 and max(read) <= 3 * 3 * 40 and read[-1] < 720 / 4
    again = Registry(spark, str(tmp_path / "t"), "id")
    again.add(rows(spark, [1, 2, 1000], "late"), "z")
    assert ids(again) == [*range(720), 1000]
