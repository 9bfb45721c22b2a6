"""nearest sentences within a document are found without a row for a pair, and letters are counted in one reading."""

import random

from pairwright.functions import models
from pairwright.functions.text import dot
from pairwright.operators import composite, retrieve
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by_pairs(sentences, targets, k, least=None, apart=None):
    """Every pair as a row."""
    rows = sentences.dropDuplicates(["doc", "sentence"]).join(targets.select("doc", "target", F.col("v").alias("w"), F.col("section").alias("other")), "doc")
    rows = (rows.where(F.col(apart) != F.col("other")) if apart else rows).withColumn("cosine", F.round(dot(F.col("v"), F.col("w")), 6))
    rows = rows if least is None else rows.where(F.col("cosine") >= least)
    order = W.partitionBy("doc", "sentence").orderBy(F.desc("cosine"), "target")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc", "sentence", "target", "cosine", "rank")


def units(spark, name, rows, id):
    return retrieve.normalised(spark.createDataFrame(rows, f"doc string, {name} {id}, v array<double>, section int"), "v")


def test_f25_nearest_equal_those_of_all_pairs(spark, monkeypatch):
    """Copies, near ties, null, unlike and empty vectors, null keys, one large document over many batches, few pairs at a time."""
    r = random.Random(11)
    some = [[r.gauss(0, 1) for _ in range(6)] for _ in range(25)]
    vector = lambda: r.choice([r.choice(some), r.choice(some), [x + r.gauss(0, 1e-7) for x in r.choice(some)], None, [1.0, None, 2.0], [1.0, 2.0], []])
    doc = lambda: r.choice(["big", "big", "big", None, *[f"d{i}" for i in range(40)]])
    said = [(doc(), i, vector(), r.choice([1, 2, None])) for i in range(700)]
    found = [(doc(), r.choice([None, f"t{i}", f"ü{i}"]), vector(), r.choice([1, 2, 3, None])) for i in range(700)]
    s, t = units(spark, "sentence", [*said, *said[:50]], "bigint"), units(spark, "target", [(a, b or "none", *c) for a, b, *c in found], "string")
    # Targets of one name would be ties that neither way decides.
    t = t.dropDuplicates(["doc", "target"]).localCheckpoint()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for most in (1 << 18, 100):
            monkeypatch.setattr(composite, "_PAIRS", most)
            for k, least, apart in ((5, None, None), (1, 0.5, "section"), (40, None, "section")):
                got = composite.nearest_within(s, t, k, least, apart)
                want = by_pairs(s, t, k, least, apart)
                assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert composite.nearest_within(s.where("doc = 'x'"), t, 5).count() == 0
    assert composite.nearest_within(s, t.where("doc = 'x'"), 5).count() == 0


def test_f25_no_row_for_a_pair(spark):
    s, t = units(spark, "sentence", [("d", 1, [1.0, 0.0], 1)], "int"), units(spark, "target", [("d", 2, [0.6, 0.8], 1)], "int")
    out = composite.nearest_within(s, t)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in out.collect()] == [("d", 1, 2, 0.6, 1)]


def test_letters_are_those_of_replacing_each(spark, monkeypatch):
    """Any piece of bytes at a time; letters beyond ASCII that have one of ASCII in lower case; null and empty texts."""
    texts = ["", None, "aZz", "ÄöK İi", "\n", "x" * 50, "Das ist ß", "zebra " * 9, "12", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    low = F.lower(F.coalesce("t", F.lit("")))
    each = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    for piece in (1 << 20, 7):
        monkeypatch.setattr(models, "_PIECE", piece)
        got = rows.select("n", models.letter_profile(F.col("t")).alias("v"), each.alias("w")).orderBy("n").collect()
        assert [r.v for r in got] == [r.w for r in got] and sum(got[2].v) == 3 and sum(got[3].v) == 3


def test_a_length_is_found_once_for_a_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "v array<double>")
    out = retrieve.normalised(rows, "v")
    assert [r.v for r in out.collect()] == [[0.6, 0.8], None, None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
