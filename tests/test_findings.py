"""Findings of the third review: tables on which a query differed from its SQL, or grew faster than its input."""

import duckdb
from pairwright.plans import PLANS


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL, sorted, over tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    plan = next(p for p in PLANS if name in p.QUERIES)
    rows = plan.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    return sorted((tuple(r) for r in rows.collect()), key=str), sorted(con.execute(f"SELECT {columns} FROM ({plan.ORACLE[name]})").fetchall(), key=str)


def documents(*texts):
    rows = ", ".join(f"({i}, {text}, 'de', 's{i % 2}', 9)" for i, text in enumerate(texts))
    return f"SELECT CAST(a AS BIGINT) AS doc_id, b AS text, c AS lang, d AS source, CAST(e AS BIGINT) AS n_chars FROM (VALUES {rows}) AS t(a, b, c, d, e)"


def test_f2_claims_share_no_filled_word(spark, tmp_path):
    """Words of the documents that are also words of the findings: the score counts those of the template only."""
    got, want = both(spark, tmp_path, "audit_claims", documents=documents("'would be'", "'patches here'", "'stayed'", "'plain'", "NULL"))
    assert got == want


def test_f5_word_bounds_are_ascii(spark, tmp_path):
    """Letters beyond ASCII end a word, as in the SQL."""
    texts = documents("'die dieö ädie die '", "'xdie die_ die7 die.'", "'the üthe theß'", "'ofä of the'", "''", "NULL")
    for name in ("keyword_buckets", "marker_dominance"):
        got, want = both(spark, tmp_path, name, documents=texts)
        assert got == want


def test_f4_all_phrases_are_signals(spark, tmp_path):
    """An item in which forty words stand in many orders has more than forty pairs of neighbours; each one found is a signal."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    text = " ".join(words + words[::2] + words[1::2] + words[::3] + words[::-1])
    items = f"SELECT CAST(1 AS BIGINT) AS item_id, '{text}' AS text"
    got, want = both(spark, tmp_path, "finding_search", documents=documents(f"'{text}'", "'something else in here'", "NULL"), benchmark=items)
    assert got == want and got[0][4] > 40


def test_f3_no_word_or_id_brings_the_third_concept_near(spark, tmp_path):
    """Texts and ids for which words of the rows fall on one place of the embedding: every pair of places for word and id is tried."""
    from pairwright.functions.models import hash_embedding
    from pairwright.plans.template_queries import COST
    from pyspark.sql import functions as F

    fixed = spark.createDataFrame([(0, "heap :: the parser leaks memory of"), (1, "leak :: memory leaks in the parser heap of"), (2, COST)], "n int, t string")
    sizes = [len(t.replace("::", "").split()) for (t,) in fixed.orderBy("n").select("t").collect()]
    units = [v for (v,) in fixed.orderBy("n").select(hash_embedding(F.col("t"))).collect()]
    counts = [[round(x / min(y for y in v if y)) for x in v] for v in units]
    assert [sum(v) for v in counts] == sizes
    for a in range(64):
        for b in range(64):
            v = [list(c) for c in counts]
            for own in v[:2]:
                own[a] += 1
                own[b] += 1
            cos = lambda p, q, v=v: sum(x * y for x, y in zip(v[p], v[q], strict=True)) / (sum(x * x for x in v[p]) * sum(x * x for x in v[q])) ** 0.5
            assert max(cos(0, 2), cos(1, 2)) < 0.499 and cos(0, 1) >= 0.5


def test_f1_a_draft_is_reviewed_in_one_projection(spark):
    """What is found of a finding and its draft is not worked out again for each sentence, and sentences are no rows to be grouped again."""
    from pairwright.operators.checks import draft_review

    findings = spark.createDataFrame([(1, "a", "An attacker could read the records. It was not fixed.\n")], "report_id bigint, ref string, source_text string")
    out = draft_review(findings, findings.selectExpr("report_id", "'An attacker accessed records. It was fixed. Nothing.' AS draft_text"))
    assert [s["level"] for s in out.first()["sentences"]] == ["red", "amber", "green"]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_f14_nearest_vectors_equal_all_pairs(spark):
    """Copies, ties of rounded cosines, null and zero vectors, null and own kinds, fewer rows than asked for."""
    import random

    from pairwright.functions.text import dot
    from pairwright.operators import retrieve
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window as W

    r = random.Random(5)
    some = [[r.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, some[r.randrange(60)] if i % 3 else [x + r.gauss(0, 1e-7) for x in some[i % 60]], None if i % 11 == 0 else f"k{i % 4}") for i in range(900)]
    rows += [(900, None, "k1"), (901, [0.0] * 8, "k2"), (902, [1.0, None] + [0.5] * 6, "k3"), (1000, [0.0] * 8, "k1"), (1100, some[3], "k9"), (1200, [float("nan")] * 8, "k0")]
    vectors = spark.createDataFrame(rows, "id bigint, v array<double>, kind string").repartition(3)
    asked = vectors.where("id % 100 = 0")
    for base, k, kind in ((vectors, 5, None), (vectors, 7, "kind"), (vectors.where("id >= 895"), 20, None), (vectors.where("id >= 895"), 20, "kind")):
        q, b = (retrieve.normalised(x, "v") for x in (asked, base))
        pairs = q.select(F.col("id").alias("query"), F.col("v").alias("q"), F.col("kind").alias("a")).crossJoin(b.select(F.col("id").alias("match"), "v", "kind")).where("query <> match")
        pairs = (pairs.where("a <> kind") if kind else pairs).withColumn("cosine", F.round(dot(F.col("q"), F.col("v")), 6))
        want = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "match"))).where(F.col("rank") <= k).select("query", "match", "cosine", "rank")
        got = retrieve.top_k(asked, base, "id", "v", k, exclude_same=kind)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    high = retrieve.top_k(asked, vectors, "id", "v", 5, least=0.9).where("not isnan(cosine)")
    assert high.count() and high.agg(F.min("cosine")).first()[0] >= 0.9


def test_f6_postings_become_no_rows(spark):
    """Counts are summed within the blocks of the index."""
    from pairwright.plans.search_queries import index_statistics

    rows = index_statistics(spark, "/root/testdata/sf0.001")
    assert not [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x and "explode(postings" in x]
    assert rows.where("n < df").count() == 0 and rows.count() > 0


def test_signatures_are_compiled_and_those_of_the_sets(spark):
    """the hashes of shingles are minima over rows, not an expression for each item of an array; bands and pairs stay the same."""
    from pairwright.operators import dedup
    from pyspark.sql import functions as F

    sets = spark.createDataFrame([(k, [k * 7 + j for j in range(k + 1)]) for k in range(9)], "id bigint, s array<bigint>")
    hashed = lambda k: F.transform("s", lambda x: F.xxhash64(F.lit(k), x))
    least = [F.array_min(hashed(k)).alias(f"m{k}") for k in range(8)]
    found = dedup._signatures(sets, 8)
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sets.select("id", *least).collect()))
