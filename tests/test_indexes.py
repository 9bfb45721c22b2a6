"""Written indexes: BM25 with and without pruning, folders that are read, vectors by filter and cell, the ladder."""

import math
import random
import re
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pairwright.operators import cells, lexicon, retrieve
from pyspark.sql import functions as F


def words(rng, n, hot=()):
    return " ".join(rng.choice(hot) if hot and rng.random() < 0.5 else f"w{rng.randint(0, 300)}x" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    hot = ["common", "often", "everywhere"]
    return [(k, words(rng, rng.randint(1, 60), hot)) for k in range(800)] + [(900, None), (901, ""), (902, "12 %%")]


@pytest.fixture(scope="module")
def queries():
    rng = random.Random(2)
    return [(1, "common often"), (2, "w17x common"), (3, "w5x w9x everywhere often common"), (4, "nowhere zebra"), (5, None), (6, words(rng, 30)), (7, "common"), (8, "w250x w250x w3x"), (9, "common often everywhere " + words(rng, 8))]


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return lexicon.build(spark.createDataFrame(docs, "id bigint, t string"), "id", "t", str(tmp_path_factory.mktemp("lex")), shard_docs=50, buckets=6)


def brute(docs, queries, k):
    terms = {i: re.findall(r"[a-z][a-z0-9]{2,}", (t or "").lower()) for i, t in docs}
    avg, df, out = sum(map(len, terms.values())) / len(docs), Counter(w for t in terms.values() for w in set(t)), []
    for q, text in queries:
        scores = {}
        for w in set(re.findall(r"[a-z][a-z0-9]{2,}", (text or "").lower())):
            for i, t in terms.items():
                if tf := t.count(w):
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 50])
@pytest.mark.parametrize("prune", [True, False])
def test_bm25(spark, docs, queries, index, k, prune):
    rows = spark.createDataFrame(queries, "id bigint, t string")
    got = sorted(tuple(r) for r in lexicon.bm25(rows, "id", "t", index, k, prune).select("query", "doc", "score", "rank").collect())
    assert got == brute(docs, queries, k)


def test_pruning_unfolds_fewer_postings(spark, queries, index, monkeypatch):
    seen = []
    added = lexicon._added

    def counted(index, terms, prune=None):
        joined = index.blocks(terms).join(terms, "term")
        joined = joined if prune is None else joined.where(prune)
        seen.append(joined.selectExpr("sum(size(postings))").first()[0] or 0)
        return added(index, terms, prune)

    monkeypatch.setattr(lexicon, "_added", counted)
    rows = spark.createDataFrame([q for q in queries if q[0] in (2, 3, 8)], "id bigint, t string")
    lexicon.bm25(rows, "id", "t", index, 3, False)
    whole = sum(seen)
    seen.clear()
    lexicon.bm25(rows, "id", "t", index, 3, True)
    assert sum(seen) < whole / 2


def test_only_asked_folders_are_read(spark, docs, queries, tmp_path):
    own = lexicon.build(spark.createDataFrame(docs, "id bigint, t string"), "id", "t", str(tmp_path), shard_docs=50, buckets=6)
    asked = spark.createDataFrame([(8, "w250x")], "id bigint, t string")
    want = lexicon.bm25(asked, "id", "t", own, 9).collect()
    kept = own.terms(spark.createDataFrame([("w250x",)], "term string")).select(own._bucket()).first()[0]
    for folder in Path(own.path).glob("*/bucket=*"):
        if folder.name != f"bucket={kept}":
            shutil.rmtree(folder)
    assert lexicon.bm25(asked, "id", "t", own, 9).collect() == want and want


def test_replaced_whole(spark, docs, tmp_path):
    path, rows = str(tmp_path), spark.createDataFrame(docs, "id bigint, t string")
    assert lexicon.current(spark, path) is None
    one = lexicon.build(rows, "id", "t", path, source="a")
    assert lexicon.current(spark, path, "a") == one and lexicon.current(spark, path, "b") is None
    two = lexicon.build(rows.limit(0), "id", "t", path, source="b")
    assert lexicon.current(spark, path) == two and two.n_docs == 0
    asked = spark.createDataFrame([(1, "common")], "id bigint, t string")
    assert lexicon.bm25(asked, "id", "t", one, 5).count() == 5  # readers of the former one go on
    assert lexicon.bm25(asked, "id", "t", two, 5).count() == 0


def test_lexical_scores_from_an_index(spark, docs, queries, index):
    rows, asked = spark.createDataFrame(docs, "id bigint, t string"), spark.createDataFrame(queries, "id bigint, t string")
    get = lambda **more: sorted((r["query"], r["doc"], r["rank"], r["score"]) for r in retrieve.search(asked, rows, "id", "t", "id", "t", limit=5, **more).collect())
    assert get(index=index) == get() != []


def test_hybrid(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query int, match int, rank int")
    sources = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"), (6, "d")], "match int, source string")
    out = retrieve.hybrid(hits([(1, 1, 1), (1, 2, 2)]), hits([(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4), (1, 6, 5), (2, 3, 1)]), sources, "source")
    got = [(r["query"], r["match"], r["via"], r["rank"]) for r in out.orderBy("query", "rank").collect()]
    assert got == [(1, 2, "hybrid", 1), (1, 3, "hybrid", 2), (1, 4, "hybrid", 3), (1, 5, "hybrid", 4), (2, 3, "dense", 1)]


# --- vectors ---


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(10)]
    return [(k, [m + rng.gauss(0, 0.4) for m in rng.choice(middles)], [None, "a", "b", "c"][min(3, k % 7)]) for k in range(1200)] + [(2000, None, "a"), (2001, [0.0] * 12, "a")]


def near(vectors, ids, k, same):
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    live = {i: (unit(v), b) for i, v, b in vectors if v and any(v)}
    out = {}
    for i in ids:
        v, b = live[i]
        scored = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)), 6), j) for j, (w, c) in live.items() if j != i and (c == b or not same))
        out[i] = [j for _, j in scored[:k]]
    return out


@pytest.fixture(scope="module")
def table(spark, vectors, tmp_path_factory):
    return cells.build(spark.createDataFrame(vectors, "id bigint, v array<double>, label string"), "id", "v", "label", str(tmp_path_factory.mktemp("cells")))


def got(rows):
    out = {}
    for r in rows.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["match"])
    return out


def test_exact_and_recall(spark, vectors, table):
    ids = list(range(0, 1200, 30))
    asked = spark.createDataFrame([vectors[i] for i in ids], "id bigint, v array<double>, label string")
    for by in (None, "label"):
        want = near(vectors, ids, 10, by is not None)
        assert got(cells.search(asked, table, "id", "v", 10, by)) == want
        some = got(cells.search(asked, table, "id", "v", 10, by, probe=6))
        hit = sum(len(set(some.get(i, [])) & set(w)) for i, w in want.items())
        assert hit >= 0.9 * sum(map(len, want.values()))


def test_other_folders_are_not_read(spark, vectors, tmp_path):
    own = cells.build(spark.createDataFrame(vectors, "id bigint, v array<double>, label string"), "id", "v", "label", str(tmp_path))
    asked = spark.createDataFrame([v for v in vectors[:700] if v[2] == "a"], "id bigint, v array<double>, label string")
    want = got(cells.search(asked, own, "id", "v", 5, "label"))
    for folder in Path(own.path).glob("vectors/by=*"):
        if folder.name != "by=a":
            shutil.rmtree(folder)
    assert got(cells.search(asked, own, "id", "v", 5, "label")) == want and want


def test_ladder(spark, vectors, table):
    ids = [2, 3, 4, 7]
    asked = spark.createDataFrame([vectors[i] for i in ids], "id bigint, v array<double>, label string")
    k = 200  # label b has fewer
    out = cells.ladder(asked, table, "id", "v", "label", k)
    strict, loose = got(out.where("rung = 0")), got(out.where("rung = 1"))
    assert strict == near(vectors, ids, k, True)
    assert set(loose) == {i for i in ids if len(strict[i]) < k} and set(loose) < set(ids)
    for i, w in near(vectors, list(loose), k, False).items():
        assert loose[i] == [j for j in w if j not in strict[i]]


def test_sums_stay_with_their_shard(spark, queries, index):
    """Blocks are dealt out by shard before they meet the queries; no posting, and no sum, moves once for each query and document."""
    asked = spark.createDataFrame(queries, "id bigint, t string")
    terms = retrieve.query_terms(asked, "id", F.col("t"), index, index.n_docs).localCheckpoint()
    for sums in (retrieve.lexical_scores(terms, index), lexicon._added(index, terms)):
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(shard#", plan) and not re.search(r"hashpartitioning\(query#\w+, doc#", plan)
