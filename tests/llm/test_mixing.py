import math

import pytest
from pairwright.llm import mixing
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    out = [(k, "w " * (10 + k % 7), "en", s) for s, n, base in (("big", 600, 0), ("mid", 150, 10_000), ("low", 30, 20_000)) for k in range(base, base + n)]
    return [*out, (30_000, None, "en", "mid"), (30_001, "", "en", "none"), (30_002, "x y z", "en", None), (5, "w " * 15, "en", "big")]


def bisected(tokens, budget, share, most):
    total = sum(tokens.values())

    def at(a):
        w = {k: (t / total) ** a for k, t in tokens.items()}
        z = sum(w.values())
        return -sum(v / z * math.log(v / z) for v in w.values()), max(v / z * budget / tokens[k] for k, v in w.items()), {k: v / z for k, v in w.items()}

    def bisect(meets):
        lo, hi = 0.0, 1.0
        if meets(at(1.0)):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if meets(at(mid)) else (lo, mid)
        return lo

    target = at(1.0)[0] + share * (at(0.0)[0] - at(1.0)[0])
    a = max(bisect(lambda v: v[0] >= target), bisect(lambda v: v[1] > most))
    return a, at(a)[2]


@pytest.mark.parametrize("share,most", [(0.5, 4.0), (1.0, 2.0), (0.2, 9.0)])
def test_budgets(docs, rows, share, most):
    table = docs(rows).withColumn("mix", F.lit("clash"))
    out = mixing.mix(table, entropy_share=share, max_repeats=most, block_words=300).cache()
    tokens = {}
    for _, t, _, s in rows:
        if (t or "").split():
            tokens[s] = tokens.get(s, 0) + len(t.split())
    budget = sum(tokens.values())
    _, want = bisected(tokens, budget, share, most)
    got = {r["source"]: r for r in out.groupBy("source").agg(F.sum("mix.n_tokens").alias("n"), F.max("mix.source_weight").alias("w"), F.max("mix.epoch").alias("e")).collect()}
    for s, w in want.items():
        if s in got:
            assert abs(got[s]["w"] - w) < 1e-6
        taken = got[s]["n"] if s in got else 0
        assert w * budget - 40 <= taken <= w * budget + 1e-3, s
    assert out.where("mix.position < 0 or mix.position >= 1").count() == 0
    assert "none" not in got
    passes = out.groupBy("doc_id", "source").agg(F.count("*").alias("c"), F.countDistinct("mix.epoch").alias("e")).where("doc_id <> 5 and c <> e")
    assert passes.count() == 0


def test_whole_passes_take_everything(docs, rows):
    out = mixing.mix(docs(rows), entropy_share=1.0, max_repeats=3.0, block_words=300)
    low = out.where("source = 'low' and mix.epoch = 0").select("doc_id").distinct().count()
    assert low == 30


def test_same_again_and_empty(docs, rows):
    a, b = (sorted((r["doc_id"], r["mix"]["epoch"], r["mix"]["position"]) for r in mixing.mix(docs(rows)).collect()) for _ in range(2))
    assert a == b
    assert mixing.mix(docs([]).limit(0)).count() == 0
    assert mixing.mix(docs([(1, None), (2, "")])).count() == 0


@pytest.mark.parametrize("bucket", [1_000, 3])
def test_blocks_are_permuted(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_BLOCKS", bucket)
    out = mixing.mix(docs(rows), entropy_share=1.0, max_repeats=3.0, block_words=40)
    spans, blocks, orders = {}, {}, {}
    for r in out.collect():
        m = r["mix"]
        spans.setdefault((r["source"], m["epoch"]), {}).setdefault(m["block"], []).append(m["position"])
        blocks.setdefault(r["source"], set()).add(m["block"])
    for (source, epoch), found in spans.items():
        ordered = sorted(found, key=lambda b: min(found[b]))
        assert all(max(found[a]) < min(found[b]) for a, b in zip(ordered, ordered[1:]))  # no two blocks overlap
        assert epoch == 0 or max(max(v) for v in spans[source, epoch - 1].values()) <= min(min(v) for v in found.values())
        orders.setdefault(source, []).append(ordered)
    assert all(set(o[0]) == blocks[s] for s, o in orders.items() if len(o) > 1)
    assert orders["low"][0] != orders["low"][1] and orders["low"][0] != sorted(orders["low"][0])


def test_ranks_and_sums_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_BLOCKS", 4)
    rng = __import__("random").Random(2)
    blocks = [(k, e, b, n, rng.choice([0.0, 0.25, rng.random()]), rng.randint(0, 9)) for k, n in (("x", 41), ("y", 1), ("z", 7)) for e in (0, 1) for b in range(n)]
    out = mixing._ranked(spark.createDataFrame(blocks, "k string, epoch int, block bigint, blocks bigint, h double, t bigint"))
    want = set()
    for key in {b[:2] for b in blocks}:
        total = 0
        for rank, (k, e, b, n, _, t) in enumerate(sorted((b for b in blocks if b[:2] == key), key=lambda b: (b[4], b[2]))):
            total += t
            want.add((k, e, b, n, t, rank, total))
    assert {tuple(r[c] for c in ("k", "epoch", "block", "blocks", "t", "rank", "upto")) for r in out.collect()} == want


def test_a_source_without_tokens_goes(docs):
    out = mixing.mix(docs([(1, "a b c", "en", "x"), (2, "", "en", "y"), (3, None, "en", "x"), (4, "w " * 300_000, "en", "x")]))
    assert {r["doc_id"] for r in out.collect()} == {1, 3, 4}
