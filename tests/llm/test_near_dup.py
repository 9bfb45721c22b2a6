import pytest
from pairwright.llm import bagminhash
from pairwright.llm.bagminhash import bag, overlap, signatures
from pairwright.llm.text import WordHashes, words_of
from pyspark.sql import functions as F


def classes(rows):
    known, best = WordHashes(), {}
    bags = {}
    for i, t in rows:
        if i is not None:
            bags.setdefault(i, []).append(bag(words_of(t), known) if words_of(t) else None)
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and any(x and y and overlap(x, y) >= 0.8 for x in bags[a] for y in bags[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    best.update({i: find(i) for i in bags})
    return best


def edited(text, at, new):
    w = text.split()
    for k in at:
        w[k] = new
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(text):
    base, other = text(1, 120), text(2, 60)
    group = [(100 + k, edited(text(7, 150), [(13 * k) % 150, (29 * k + 5) % 150], f"w{k}")) for k in range(40)]
    return [
        (5, base), (3, base.upper()), (9, edited(base, [60], "new")), (11, edited(base, [10, 60, 100], "other")), (12, other), (13, other + " " + other), (14, None), (15, ""), (16, "..."), (17, "one two"), (18, "One, two!"), (19, "one two three"),
        (20, text(3, 20_000)), (21, edited(text(3, 20_000), [500], "x")), (5, base), (22, "again " * 400), (23, "again " * 390), *group,
    ]


def test_classes_equal_brute_force(docs, rows):
    out = bagminhash.classes(docs(rows).withColumn("class_id", F.lit("clash")))
    assert {r["id"]: r["class_id"] for r in out.collect()} == classes(rows)
    assert out.count() == len(rows)


def test_one_of_each_class_stays(docs, rows):
    want = sorted(set(classes(rows).values()))
    kept = bagminhash.dedup(docs([*rows, (None, "null id")])).withColumn("n", F.lit(1))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 1
    assert kept.columns[:4] == ["doc_id", "text", "lang", "source"]


def test_empty(docs):
    assert bagminhash.classes(docs([]).limit(0)).count() == 0
    assert bagminhash.dedup(docs([(1, None)])).count() == 1


def test_signatures_are_unbiased(text):
    known = WordHashes()
    a = bag(words_of(text(1, 300) + " " + " ".join(["same five words in turn"] * 30)), known)
    b = bag(words_of(edited(text(1, 300), [5, 90, 170, 250], "z") + " " + " ".join(["same five words in turn"] * 50)), known)
    s = signatures([a, b], 2048)
    assert abs((s[0] == s[1]).mean() - overlap(a, b)) < 0.05


@pytest.mark.parametrize("similarity,recall", [(0.8, 0.99), (0.85, 0.999)])
def test_recall_of_bands_and_sketches(similarity, recall):
    """Of random bags of that weighted similarity: how many share a band and pass the limits of both sketches."""
    import numpy as np
    from pairwright.llm.store import FINE, PLANES, most_different
    from pairwright.llm.text import mixed, sketch

    rng, n, size = np.random.default_rng(5), 600, 60
    common = int(np.ceil(size * 2 * similarity / (1 + similarity)))
    pools = [mixed(rng.integers(0, 1 << 63, 2 * size - common).astype(np.uint64)) for _ in range(n)]
    weights = [rng.integers(1, 4, len(p)) for p in pools]
    sides = [[(p[a:b], w[a:b]) for p, w in zip(pools, weights)] for a, b in ((0, size), (size - common, 2 * size - common))]
    exact = np.array([overlap(tuple(map(np.array, zip(*sorted(zip(*x))))), tuple(map(np.array, zip(*sorted(zip(*y)))))) for x, y in zip(*sides)])
    chosen, found = exact >= similarity, np.ones(n, bool)
    for registers in (bagminhash.BANDS * bagminhash.ROWS, FINE):
        a, b = (signatures(side, registers).view(np.uint64) for side in sides)
        x, y = (sketch(r).reshape(n, PLANES, -1) for r in (a, b))
        found &= np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=1)).sum(axis=1) <= most_different(registers, 0.8)
        if registers != FINE:
            found &= (a == b).reshape(n, bagminhash.BANDS, bagminhash.ROWS).all(axis=2).any(axis=1)
    assert chosen.sum() > 100 and found[chosen].mean() >= recall
