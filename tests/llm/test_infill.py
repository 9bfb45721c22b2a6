import hashlib
import re

import pytest
from pairwright.llm import infill
from pyspark.sql import functions as F


def brute(id, text, seed=1, plain=10, spm=20):
    text = text or ""
    u = re.findall(infill.UNIT, text)
    h = [int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows(text):
    odd = [None, "", " ", "a", "漢字 und 🙂🙂 so", "no <S> here", "<", "<S", "x<P", "a\r\n\n\tb", "é" * 40, "Z" * 5000, "1" * 5000, "\x00a", "<<>>" * 30, "word " * 20_000]
    out = [(100 * k + j, t) for k, t in enumerate(odd) for j in range(9)]
    out += [(5000 + k, text(k, 3 + 7 * k % 200)) for k in range(300)] + [(5001, text(900, 30)), (5001, text(901, 40)), (5001, text(900, 30)), (None, text(902, 50)), (None, text(902, 50))]
    return out


@pytest.mark.parametrize("seed,plain,spm", [(1, 10, 20), (7, 0, 50), (3, 100, 0)])
def test_as_brute_force(docs, rows, seed, plain, spm):
    table = docs(rows).withColumn("fim", F.lit("clash")).withColumn("k1", F.lit(1)).withColumn("n", F.lit(2)).withColumn("row", F.lit(3)).repartition(7)
    out = infill.infill(table, seed=seed, plain_percent=plain, spm_percent=spm)
    assert out.columns == ["doc_id", "text", "lang", "source", "k1", "n", "row", "fim"]
    got = [(r["doc_id"], r["text"], tuple(r["fim"]), r["back"]) for r in out.withColumn("back", infill.restored(F.col("fim.output"), F.col("fim.form"))).collect()]
    want = [(i, t, brute(i, t, seed, plain, spm), t or "") for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_row_repeated_very_often(spark):
    text = "one two three, four five six. " * 20
    out = infill.infill(spark.range(20_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit(text).alias("text")))
    assert [(tuple(r[0]), r[1]) for r in out.groupBy("fim").count().collect()] == [(brute(3, text), 20_000)]


def test_empty_table(docs):
    assert infill.infill(docs([]).limit(0)).count() == 0
