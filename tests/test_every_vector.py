"""Nearest vectors when every vector is a query (findings of the fourth review)."""

from test_findings import both


def test_f7_f8_every_vector_is_asked(spark, tmp_path):
    """Not only each hundredth one; and the rows are those of the SQL."""
    vectors = "SELECT CAST(i AS BIGINT) AS vec_id, [CAST((i * 7919 % 101) + d * (i % 13) AS FLOAT) FOR d IN range(1, 9)] AS embedding, CAST(i % 3 AS INTEGER) AS label FROM range(1, 140) t(i)"
    for name in ("cosine_argmax_excl_group", "rank_fusion"):
        got, want = both(spark, tmp_path, name, embeddings=vectors)
        assert got == want and len({r[0] for r in got}) == 139


def test_f7_a_half_is_rounded_as_in_the_sql(spark, tmp_path):
    vectors = "SELECT CAST(i AS BIGINT) AS vec_id, CAST([x, sqrt(1 - x * x)] AS FLOAT[]) AS embedding, CAST(i AS INTEGER) AS label FROM (VALUES (1, 1.0::DOUBLE), (2, 0.38835), (3, -0.38835)) t(i, x)"
    got, want = both(spark, tmp_path, "cosine_argmax_excl_group", embeddings=vectors)
    assert got == want and (1, 2, 0.3883) in got


def test_f7_f8_blocks_equal_queries_sent(spark, monkeypatch):
    """More queries than are sent to all tasks meet the base block by block, with the same rows: copies, null and zero vectors, other widths, null kinds, several lists."""
    import random

    from pairwright.operators import retrieve

    r = random.Random(6)
    some = [[r.gauss(0, 1) for _ in range(8)] for _ in range(70)]
    rows = [(i, some[r.randrange(70)] if i % 3 else [x + r.gauss(0, 1e-7) for x in some[i % 70]], None if i % 11 == 0 else f"k{i % 4}") for i in range(800)]
    rows += [(900, None, "k1"), (901, [0.0] * 8, "k2"), (902, [1.0] * 5, "k3"), (903, [2.0, 1.0, 1.0, 3.0, 1.0], "k1"), (904, [float("nan")] * 8, "k0"), (905, [1.0, None] + [0.5] * 6, None)]
    vectors = spark.createDataFrame(rows, "id bigint, v array<double>, kind string").repartition(3)
    lists, part = [(5, True), (7, False), (1, True)], vectors.where("id % 2 = 0")
    run = lambda q, b: sorted(map(str, retrieve.top_lists(q, b, "id", "v", lists, "kind").collect()))
    sent = run(vectors, vectors), run(part, vectors), run(vectors, part)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 100)
    monkeypatch.setattr(retrieve, "_BLOCK_ROWS", 120)
    monkeypatch.setattr(retrieve, "_TASK_BLOCKS", 3)
    monkeypatch.setattr(spark.sparkContext, "broadcast", None)  # nothing is sent through the driver
    assert (run(vectors, vectors), run(part, vectors), run(vectors, part)) == sent
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run(vectors, part) == sent[2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
