import hashlib
import re

import pytest
from pairwright.llm import decontam
from pyspark.sql import functions as F


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    w, hit, found = tokens(text), set(), set()
    for name, t in items:
        if name is None:
            continue
        p = tokens(t)
        k = min(width, len(p))
        for i in range(len(p) - k + 1 if p else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == p[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def case(text):
    passage, other = text(11, 14), text(12, 30)
    items = [(1, passage), (2, other), (3, "Zulu"), (10, passage), (4, None), (5, ""), (None, text(13, 12)), (2, other)]
    rows = [
        (1, text(20, 30) + " " + passage + ". " + text(21, 5)), (2, passage[:40]), (3, None), (4, ""), (5, "zulu ZULU x zulu"), (6, " ".join(other.split()[3:15]) + "\n" + " ".join(other.split()[5:25]).upper()),
        (7, text(30, 3000) + " " + other), (7, text(31, 20)), (8, text(32, 200)), (9, passage.replace(" ", "... ")), (12, " ".join(passage.split()[:9])),
    ]
    return rows, items


@pytest.mark.parametrize("shard,block", [(100_000, 1_000_000), (50, 10)])
def test_against_brute_force(spark, docs, case, shard, block):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontam.search(decontam.build_index(docs(rows).withColumn("id", F.lit("clash")), shard_words=shard), bench, query_words=block)
    got = sorted((r["id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), list(r["items"])) for r in out.collect())
    assert got == sorted((d, *brute(t, items)) for d, t in rows)


def test_digest_and_empty_tables(spark, docs, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontam.contamination(docs([]).limit(0), bench).count() == 0
    clean = decontam.contamination(docs(rows), bench.limit(0)).where("n_hit > 0")
    assert clean.count() == 0
    kept = {r["doc_id"] for r in decontam.decontaminated(docs(rows), bench).collect()}
    assert kept == {2, 3, 4, 8, 12}
    assert hashlib.sha256(b"1,10").hexdigest() in [r[0] for r in decontam.contamination(docs(rows), bench).select(F.sha2(F.array_join("items", ","), 256)).collect()]


def test_proximity(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    rows = docs([(1, "gamma x alpha beta"), (2, "alpha beta q q q q q q gamma"), (3, "alpha gamma"), (4, "beta alpha gamma")])
    near = {r["doc_id"] for r in decontam.contamination(rows, bench, slop=2).where("n_hit > 0").collect()}
    assert near == {1, 4}


def brute_near(text, items, width, slop):
    w, hit, found = tokens(text), set(), set()
    for name, t in items:
        p = tokens(t)
        k = min(width, len(p))
        for window in {tuple(sorted(p[i : i + k])) for i in range(len(p) - k + 1 if p else 0)}:
            holds = lambda a, z, window=window: all(w[a:z].count(x) >= window.count(x) for x in window)
            for a in range(len(w)):
                for z in range(a + k, min(a + k + slop, len(w)) + 1):
                    if holds(a, z) and not holds(a + 1, z) and not holds(a, z - 1):
                        hit |= set(range(a, z))
                        found.add(str(name))
    return len(hit), sorted(found)


@pytest.mark.parametrize("shard,width,slop", [(100_000, 3, 2), (12, 3, 0), (100_000, 4, 5), (25, 2, 3)])
def test_proximity_against_brute_force(spark, docs, shard, width, slop):
    rng = __import__("random").Random(shard + width)
    line = lambda n, a: " ".join(rng.choice(a) for _ in range(n))
    rows = [(k, line(rng.randint(0, 14), "abcdefrx")) for k in range(60)] + [(100, "x x a"), (101, "r x x x a")]
    items = [(k, line(rng.randint(1, 5), "abcdefr")) for k in range(8)] + [(20, "r a"), (21, "a a b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.search(decontam.build_index(docs(rows), shard_words=shard), bench, width=width, slop=slop)
    got = {r["id"]: (sum(s["stop"] - s["start"] for s in r["spans"]), list(r["items"])) for r in found.collect()}
    assert got == {d: brute_near(t, items, width, slop) for d, t in rows}
