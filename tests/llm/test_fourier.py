import random
import zlib

import numpy as np
import pytest
from pairwright.llm import fourier
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(text):
    rng, out = random.Random(5), []
    for k in range(900):
        t = text(k, rng.randint(3, 200))
        bad = k % 4 == 0
        out.append((k, [" ".join(w + "$$$" for w in t.split()), t.upper().replace(" ", "!! "), "same " * 80, " | ".join(t.split())][k // 4 % 4] if bad else t + ".", int(not bad)))
    return out


def learned(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(parts)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 1 - rows[1][2]), (2, None), (99_999, 1), (None, 1)], "doc_id bigint, quality int")
    stats = fourier.statistics(docs)
    part = F.crc32(F.col("id").cast("string")) % 5
    learn = fourier.labelled(stats.where(part != 0), labels, "doc_id", "quality")
    return stats, learn, fourier.fit(learn.where(part != 4), learn.where(part == 4))


def test_held_out_and_any_partitions(spark, rows):
    stats, learn, model = learned(spark, rows)
    assert learn.where("id = 1").count() == 0  # both labels
    got = {r["id"]: r["score"] for r in fourier.scored(stats, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.3, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(p == bool(q) for p, q in held) >= 0.97 * len(held)
    again_stats, _, again = learned(spark, rows, parts=8)
    assert {r["id"]: r["score"] for r in fourier.scored(again_stats, again).collect()} == got


def test_normal_equations_as_plain_ridge(spark, rows):
    _, learn, model = learned(spark, rows)
    part = F.crc32(F.col("id").cast("string")) % 5
    train = learn.where(part != 4).collect()
    stats, y = np.array([r["stats"] for r in train], float), np.array([r["label"] for r in train], float)
    assert np.allclose(model.mean, stats.mean(axis=0), rtol=1e-9) and np.allclose(np.where(model.deviation == fourier.UNIT, 0, model.deviation), stats.std(axis=0), rtol=1e-6, atol=1e-3)
    z = model.waves(stats) / fourier.WAVE
    penalty = np.eye(z.shape[1]) * 1e-3 * len(y)
    penalty[-1, -1] = 0
    plain = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(z @ plain, model.raw(stats), atol=1e-5)


def test_kernel(spark):
    model = fourier.Model(np.zeros(3), np.ones(3), np.random.default_rng(1).normal(0, 1 / 3**0.5, (3, 4000)), np.random.default_rng(2).uniform(0, 2 * np.pi, 4000), np.zeros(4001), np.zeros(1), np.zeros(1))
    x = np.random.default_rng(3).normal(0, 1, (20, 3))
    z = model.waves(x)[:, :-1] / fourier.WAVE
    gauss = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 6)
    assert np.abs(2 * z @ z.T / 4000 - gauss).max() < 0.1


def test_isotonic():
    at = np.arange(7.0)
    steps, levels = fourier.isotonic(at, np.array([0, 1, 0, 1, 3, 2, 4]), np.array([2, 2, 2, 2, 4, 4, 4]))
    want = [0, 0.25, 0.25, 0.5, 5 / 8, 5 / 8, 1]
    assert np.allclose(np.interp(at, steps, levels), want) and (np.diff(levels) >= 0).all()


def test_nothing_to_learn_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, " \n ", "x"), (3, "漢字 🙂 " * 30_000, "x"), (None, "a b", "x")], "doc_id bigint, text string, stats string")
    stats = fourier.statistics(docs)
    none = stats.select("stats", F.lit(1).alias("label")).limit(0)
    assert [r["score"] for r in fourier.scored(stats, fourier.fit(none, none)).collect()] == [0.5] * 5
    one = stats.select("stats", F.lit(1).alias("label"))
    assert all(0 <= r["score"] <= 1 for r in fourier.scored(stats, fourier.fit(one, none)).collect())
    assert all(r["score"] == 1 for r in fourier.scored(stats, fourier.fit(one, one)).collect())
    empty = fourier.scored(fourier.statistics(docs.limit(0)), fourier.fit(none, none))
    assert empty.count() == 0 and empty.columns == ["id", "score"]
