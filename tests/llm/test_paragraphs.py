import numpy as np
import pytest
from pairwright.llm import paragraphs
from pairwright.llm.text import words_of
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(text):
    passage, para = text(1, 60), text(2, 40)
    near = para.split()
    near[0] = "changed"
    return [
        (1, text(10, 30) + " " + passage + " " + text(11, 20)), (2, text(12, 5) + "\n" + text(13, 40) + " " + passage), (3, text(14, 100)), (4, para + "\n" + text(15, 30)), (5, text(16, 30) + "\n" + " ".join(near)), (6, text(17, 30) + "\n" + para.upper()),
        (7, None), (8, ""), (9, text(18, 19)), (10, text(18, 19)), (11, text(19, 20_000)), (12, " ".join(text(19, 20_000).split()[7_000:7_100])), (13, passage + "\n" + passage), (3, text(14, 100)), (None, passage),
    ]


def test_repeats(docs, rows):
    out = paragraphs.repeats(docs(rows).withColumn("spans", F.lit("clash")))
    assert out.count() == len(rows)
    got = {r["id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in out.collect()}
    clean = {1, 3, 4, 7, 8, 9, 10, 11, None}
    assert {k for k, v in got.items() if not v} == clean
    for k, begin, size in ((2, 45, 60), (12, 0, 100)):
        covered = sum(b - a for a, b in got[k])
        assert all(begin <= a < b <= begin + size for a, b in got[k]) and covered >= 20, k
    assert got[5] == [(30, 70)] and got[6] == [(30, 70)] and got[13][-1][1] == 120
    seen = set()
    for k, t in sorted({k: t for k, t in rows if k is not None}.items()):
        w = words_of(t)
        mine = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        if mine & seen:
            assert got[k], k
        seen |= mine


def test_spans_against_brute_force(docs):
    """Every 50 words in a row that stand in an earlier place are inside the spans; every word of a span stands in 20 that do."""
    import random

    rng = random.Random(6)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    shared = [fresh(n) for n in (50, 51, 64, 90, 130)]
    rows = []
    for k in range(40):
        w = fresh(rng.randint(5, 60))
        for _ in range(rng.randint(0, 2)):
            w += rng.choice(shared) + fresh(rng.randint(1, 40))
        rows.append((k, " ".join(w)))
    rows += [(50, " ".join(shared[4][:75])), (51, " ".join(fresh(9) + shared[4][20:] + fresh(3))), (52, " ".join(fresh(9) + shared[4][20:] + fresh(3)))]
    rows = [(k, t + "\n") for k, t in rows]
    got = {r["id"]: r["spans"] for r in paragraphs.repeats(docs(rows), min_words=1000).collect()}
    early, seen = set(), set()
    for k, t in rows:
        w, marked = t.split(), set()
        for s in got[k]:
            marked |= set(range(s["start"], s["stop"]))
        inside = set()
        for i in range(len(w)):
            if tuple(w[i : i + 50]) in seen and len(w) >= i + 50:
                assert set(range(i, i + 50)) <= marked, (k, i)
            if tuple(w[i : i + 20]) in early:
                inside |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 50]))
            early.add(tuple(w[i : i + 20]))
        assert marked <= inside, k


@pytest.mark.parametrize("similarity,recall", [(0.8, 0.97), (0.85, 0.99), (0.9, 0.99)])
def test_recall_of_bands_and_sketches(similarity, recall):
    """Of random pairs of that similarity: how many share a band and pass the limits of both sketches."""
    from pairwright.llm.store import FINE, PLANES, most_different
    from pairwright.llm.text import mixed, sketch

    rng = np.random.default_rng(3)
    bands, n, size = paragraphs.tuned_bands(), 1500, 90
    odd = np.uint64(0x9E3779B97F4A7C15)
    common = int(round(size * 2 * similarity / (1 + similarity)))
    sets = [rng.integers(0, 1 << 63, 2 * size - common).astype(np.uint64) for _ in range(n)]
    sides = [np.concatenate([mixed(x) for s in sets for x in (s[:size] if side == 0 else s[size - common :],)]) for side in (0, 1)]
    starts = np.arange(n) * size
    found = np.ones(n, bool)
    for registers in (bands * paragraphs.ROWS, FINE):
        salts = mixed(np.arange(1, registers + 1, dtype=np.uint64) * odd)
        a, b = (paragraphs.minhash(x, starts, salts) for x in sides)
        agree = (a == b).mean(axis=1)
        exact = common / (2 * size - common)
        assert abs(agree.mean() - exact) < 4 * (exact * (1 - exact) / (n * registers)) ** 0.5 + 0.003  # the salts are unbiased
        words = -(-registers // 64)
        x, y = sketch(a).reshape(n, PLANES, words), sketch(b).reshape(n, PLANES, words)
        differing = np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=1)).sum(axis=1)
        found &= differing <= most_different(registers, 0.8)
        if registers != FINE:
            found &= (a == b).reshape(n, bands, paragraphs.ROWS).all(axis=2).any(axis=1)
    assert found.mean() >= recall


def test_anchors_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    a, passage, b = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (333, 50, 270))
    hasher = paragraphs.RunHashes()

    def anchors(words):
        at = np.arange(len(words) - paragraphs.GRAM + 1)
        every = hasher.runs(hasher.sums(words), at, at + paragraphs.GRAM)
        return set(every[paragraphs.anchors_of(every)].tolist())

    assert anchors(passage) and anchors(passage) & anchors(np.concatenate([a, passage, b]))
    run = lambda words, i, j: hasher.runs(hasher.sums(words), np.array([i]), np.array([j]))[0]
    assert run(np.concatenate([a, passage]), 333, 383) == run(passage, 0, 50) != run(passage[::-1].copy(), 0, 50)
    assert paragraphs.tuned_bands() == 12


def test_empty(docs):
    assert paragraphs.repeats(docs([]).limit(0)).count() == 0
