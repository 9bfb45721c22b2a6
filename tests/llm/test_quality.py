import re
from collections import Counter

from pairwright.llm import quality
from pyspark.sql import functions as F


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def prose(words):
    """A stop word in eleven."""
    return " ".join(w if k % 10 else "the " + w for k, w in enumerate(words.split()))


def test_counts_and_verdicts(docs, text):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b c a b c"), (5, "x y"), (6, prose(text(1, 80))), (7, ("of the end " * 100).strip()),
        (8, "the of " + " ".join(w + "***" for w in text(2, 90).split())), (9, "same line here\nsame line here\n\n same line here"), (10, prose(text(3, 5000))), (10, prose(text(3, 5000))), (12, "the and " + text(4, 20_000)), (13, prose(text(5, 60_000))), (11, "é ü 漢字   the of"),
    ]
    out = quality.judge(docs(rows).withColumn("quality", F.lit("clash")))
    assert out.columns == ["doc_id", "text", "lang", "source", "quality"]
    got = {}
    for r in out.collect():
        q = r["quality"]
        got[r["doc_id"]] = q["kept"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute(r["text"]), r["doc_id"]
        assert q["base_failed"] == (q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"])
        assert not (q["kept"] and q["base_failed"])
    assert out.count() == len(rows)
    assert not got[12] and got[13]  # two stop words are too few for a long text
    assert got[6] and got[10] and not got[7] and not got[8] and not got[1]


def test_empty_table(docs):
    assert quality.judge(docs([]).limit(0)).count() == 0
