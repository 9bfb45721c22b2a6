"""What making the index and searching it takes of disk (findings of the fourth review), and rows that share an id."""

import random

from pairwright.operators import lexicon
from test_findings import both


def test_f5_rows_that_share_an_id_are_one_document(spark, tmp_path):
    """Their terms and lengths are summed, as in the SQL, whatever the lengths."""
    docs = "SELECT CAST(a AS BIGINT) AS doc_id, b AS text, 'x' AS source FROM (VALUES (1, 'alpha beta beta'), (1, 'beta gamma delta epsilon'), (2, 'beta'), (3, 'Alpha zeta eta'), (4, NULL), (5, '')) t(a, b)"
    items = "SELECT CAST(a AS BIGINT) AS item_id, b AS text FROM (VALUES (1, 'beta alpha'), (2, 'gamma gamma zeta'), (3, 'nowhere'), (4, NULL)) t(a, b)"
    for name in ("bm25_search", "index_statistics", "lexical_search"):
        got, want = both(spark, tmp_path, name, documents=docs, benchmark=items)
        assert got == want and got


def test_f5_only_texts_are_shuffled(spark, tmp_path):
    """A posting is no row of a shuffle: what is written there is about the texts, not a multiple of them."""
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randint(0, 30_000)}" for _ in range(400))) for k in range(1500)]
    texts = spark.createDataFrame(rows, "id bigint, t string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    index = lexicon.build(texts, "id", "t", str(tmp_path), shard_docs=200)
    assert index.n_tokens > 0 and written() - before < 1.5 * sum(len(t) for _, t in rows)


def test_f2_texts_are_not_shuffled(spark, tmp_path):
    """Facts of documents are made where the texts lie; texts of the shortlists alone, here a third, may move to meet them."""
    from pairwright.operators import retrieve

    rng = random.Random(7)
    docs = [(k, f"alpha{k % 7} beta{k % 5} network access control " + "".join(chr(rng.randint(33, 90)) for _ in range(20_000))) for k in range(300)]
    texts = spark.createDataFrame(docs, "id bigint, t string").repartition(4)
    texts.write.parquet(str(tmp_path / "texts"))
    texts, asked = spark.read.parquet(str(tmp_path / "texts")), spark.createDataFrame([(1, "alpha1 beta2 network"), (2, "alpha3 beta1 privilege")], "id bigint, t string")
    index = lexicon.build(texts, "id", "t", str(tmp_path / "lex"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        found = sorted(map(str, retrieve.search(asked, texts, "id", "t", "id", "t", limit=3, index=index).collect()))
        assert len(found) == 6 and written() - before < 0.6 * sum(len(t) for _, t in docs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_f2_signs_leave_no_topic_out(spark):
    from pairwright.operators import retrieve
    from pyspark.sql import functions as F

    words = ["NetWork", "routing", "Firewall", "VPN", "web", "HTTP", "xss", "cross-site", "browser", "cryptographic", "encrypts", "cipher", "signature", "Key Exchange", "access control", "authorized", "privilege", "permission"]
    words += ["cloud", "S3", "aws", "azure", "kubernetes", "buffer overflow", "use-after-free", "use after free", "memory corruption", "heap", "ICS", "scada", "plc", "industrial control", "xheap", "heaps", "İCS", "keyexchange", ""]
    rows = spark.createDataFrame([(f"a {w} b",) for w in words] + [(" ".join(words),), (None,)], "t string")
    plain = F.filter(F.array(*[F.when(F.col("t").rlike(p), F.lit(n)) for n, p in retrieve.TOPIC_WORDS]), lambda x: x.isNotNull())
    assert rows.where(~plain.eqNullSafe(retrieve.topics_in(F.col("t"))) & F.col("t").isNotNull()).count() == 0 and rows.where(F.size(plain) > 0).count() >= 31
