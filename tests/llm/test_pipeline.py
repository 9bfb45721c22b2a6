import corpus_pipeline
from pairwright.llm.queries import QUERIES


def test_stages(spark, tmp_path, text):
    body = lambda k: "the and of to in " + text(k, 70)
    leak = text(999, 15)
    rows = [
        (1, body(1), "en", "a", 0), (2, body(1), "en", "a", 0), (3, body(3) + "\nthe " + text(4, 20), "en", "b", 0), (4, body(5).replace(" ", "\n", 3) + "\nthe " + text(4, 20), "en", "b", 0), (5, "too short", "en", "b", 0), (6, None, "en", None, 0),
        (7, body(7) + " " + leak, "en", "b", 0), (8, body(8), None, None, 0), (9, body(8).replace(" ", "  ", 5), "en", "c", 0), (10, body(10), "en", "c", 0), (10, body(10), "en", "c", 0),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted({r["doc_id"] for r in docs.collect()}))
    assert seen[0] == [1, 2, 3, 4, 7, 8, 9, 10]
    assert seen[1] == [1, 3, 4, 7, 8, 9, 10] or seen[1] == [1, 3, 4, 7, 8, 10]
    assert seen[2] == [1, 3, 4, 7, 8, 10] and seen[3] == [1, 3, 4, 8, 10]
    assert set(seen[4]) <= set(seen[3])
    lines = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert lines[3].count("\n") == 1 and text(4, 20) not in lines[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert "pipeline" in QUERIES


def test_stages_of_empty_tables_and_clashing_names(spark, tmp_path, text):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, lines string, quality string, id string"
    for rows in ([], [(None, None, None, None, None, "l", "q", "i"), (1, "the and of to in " + text(1, 60), "en", None, 0, "l", "q", "i"), (1, "the and of to in " + text(1, 60), "en", None, 0, "l", "q", "i"), (2, "the and of to in ".join(text(k, 50) + " " for k in range(600)), "en", "s", 0, "l", "q", "i")]):
        docs = spark.createDataFrame(rows, names)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            docs = out
        assert {r["doc_id"] for r in docs.collect()} <= {1, 2} and (docs.count() > 0) == bool(rows)
