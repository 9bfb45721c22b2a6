from pairwright.functions import models, text
from pairwright.operators import retrieve, scoring
from pyspark.sql import functions as F


def test_slots(spark):
    rows = spark.createDataFrame([(1, "the parser leaks memory"), (2, "memory leaks in the parser"), (3, "billing page"), (4, "")], "id int, t string")
    v = {r["id"]: r["vector"] for r in models.embedded(rows, "t").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert cos(1, 2) > 0.8 > cos(1, 3) and abs(cos(1, 1) - 1) < 1e-9 and not any(v[4])
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, match int, rank int")
    assert models.reranked(hits) is hits
    other = models.reranked(hits, lambda h: h.withColumn("relevance", F.col("match").cast("double")))
    assert {r["match"]: r["rank"] for r in other.collect()} == {10: 2, 11: 1}


def test_entailment(spark):
    rows = spark.createDataFrame([("It allows reading", [3.0, 0.0, 0.0]), ("It allows reading", [0.0, 0.0, 3.0]), ("It allows reading", [0.0, 3.0, 0.0]), ("Fine weather today", [3.0, 0.0, 0.0])], "s string, l array<double>")
    got = [[f["check"] for f in r["f"]] for r in rows.select(models.entailment_flags(F.col("s"), F.col("l")).alias("f")).collect()]
    assert got == [["nli_contradiction"], [], ["nli_unsupported"], []]
    levels = [r[0] for r in rows.select(models.reviewed_level(F.lit("green"), F.concat("s", F.lit(" of all data")), F.col("l"))).collect()]
    assert levels == ["red", "green", "amber", "red"]


def test_scores(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(scoring.keyword_density(F.lit("patch patch"), "patch", F.lit("the patch"))) == 4.5
    assert f(scoring.dominance(F.lit("code code law"), "code", "law")) == "technical" and f(scoring.dominance(F.lit("x"), "code", "law")) is None
    assert f(scoring.parsed_limit(F.lit("between 120 to 180 words")))[:] == ("words", 180.0, True) and f(scoring.parsed_limit(F.lit("2 pages")))[:] == ("pages", 2.0, False)
    assert f(scoring.section_stats(F.lit("# A\nCVE-2024-1111 and CVE-2024-1111")))["n_ids"] == 1
    rows = spark.createDataFrame([("d", 1, "code"), ("d", 2, "law law"), ("e", 3, "code code"), ("e", 4, "code law")], "doc string, n int, t string")
    got = {r["n"]: r["bucket"] for r in scoring.bucketed(rows, "doc", F.regexp_count("t", F.lit("code")), F.regexp_count("t", F.lit("law")), 2.0).collect()}
    assert got == {1: "technical", 2: "executive", 3: "technical", 4: "executive"}


def test_weak_names(spark):
    names = spark.createDataFrame([("Acme Security Review 2024",), ("short",)], "name string")
    keys = spark.createDataFrame([("security-review-2024",), ("acme_security_review_2024_final",), ("unrelated document",), ("short",)], "key string")
    assert {r["key"] for r in scoring.weak_name_matches(names, keys).collect()} == {"security-review-2024", "acme_security_review_2024_final"}


def test_analogies_and_ladder(spark):
    queries = spark.createDataFrame([(1, "a buffer overflow in the heap"), (2, "nothing")], "id int, t string")
    library = spark.createDataFrame([("mailbox", "buffer overflow", 0.5), ("mailbox", "heap", 0.5), ("key", "heap", 0.9)], "concept string, term string, confidence double")
    assert [(r["query"], r["concept"], r["points"]) for r in retrieve.analogies(queries, library, "id", "t").collect()] == [(1, "mailbox", 6)]
    a = spark.createDataFrame([(1, 10, 1)], "query int, match int, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, match int, rank int")
    assert {(r["match"], r["rung"]) for r in retrieve.ladder([a, b]).collect()} == {(10, 0), (11, 1)}
    source = b.withColumn("src", F.lit("s"))
    assert retrieve.one_per_source(source, "src").count() == 1
    texts = spark.createDataFrame([(10, "s1", "d1"), (11, "s2", "d2")], "match int, source_text string, draft_text string")
    assert retrieve.prompt(b, texts, "Head").first()["prompt"] == "Head\n\nSource: s2\nDraft: d2\n\nSource: s1\nDraft: d1"
    assert spark.range(1).select(text.first_json_object(F.lit('say {"a": {"b": 1}} ok'))).first()[0] == '{"a": {"b": 1}}'
