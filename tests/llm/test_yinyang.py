import hashlib
import math
import random

import numpy as np
import pytest
from pairwright.llm import yinyang

SCHEMA = "vec_id bigint, embedding array<float>, cluster string"


def brute(rows, k, rounds, dims, scale=64, seed=1):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, [max(-yinyang.LIMIT, min(yinyang.LIMIT, c)) for c in v]) for i, v in kept]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return sorted((str(i), near(v)[1], near(v)[0], tuple(centroids[near(v)[1]])) for i, v in kept)


def rows_of(seed, n, dims, spread=0.2, places=9, step=None):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(places)]
    value = lambda m: (round((m + rng.gauss(0, spread)) / step) * step if step else m + rng.gauss(0, spread))
    return [(k, [value(m) for m in rng.choice(middles)]) for k in range(n)]


@pytest.mark.parametrize("seed,dims,k,rounds,groups,step", [(1, 8, 16, 3, None, None), (2, 2, 16, 5, 3, 0.25), (3, 1, 7, 4, 7, 0.5), (4, 6, 5, 0, 1, None), (5, 3, 30, 6, None, 0.1)])
def test_as_plain_rounds(spark, seed, dims, k, rounds, groups, step):
    rows = rows_of(seed, 400, dims, step=step)
    rows += [(1000, None), (1001, []), (1002, [0.0] * (dims + 1)), (1003, [float("nan")] * dims), (1004, [float("inf")] * dims), (1005, [None] * dims), (1006, [3e38] * dims), (None, [0.5] * dims), (7, [0.5] * dims), (7, [0.5] * dims)]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(5)
    out = yinyang.clusters(table, k=k, rounds=rounds, dims=dims, groups=groups).collect()
    want = brute(rows, k, rounds, dims)
    assert sorted((str(r["id"]), r["cluster"], r["distance"], tuple(r["centroid"])) for r in out) == want
    assert {r["inertia"] for r in out} == {sum(w[2] for w in want)}
    for c in {w[1] for w in want}:
        assert {r["cluster_inertia"] for r in out if r["cluster"] == c} == {sum(w[2] for w in want if w[1] == c)}


def test_bounds_save_distances(spark):
    rows = rows_of(11, 3000, 16, spread=0.05, places=16)
    out = yinyang.clusters(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), dims=16, rounds=6)
    assert out.agg({"seen": "sum"}).first()[0] < 0.6 * 3000 * 16 * 7


def test_few_or_no_vectors(spark):
    make = lambda rows: yinyang.clusters(spark.createDataFrame(rows, SCHEMA), dims=2)
    assert make([]).count() == 0 and make([(1, None, "")]).columns == ["id", "cluster", "distance", "centroid", "cluster_inertia", "inertia", "seen"]
    assert [(r["id"], r["cluster"], r["distance"]) for r in make([(1, [1.0, 1.0], ""), (2, [1.0, 1.0], "")]).orderBy("id").collect()] == [(1, 0, 0), (2, 0, 0)]
