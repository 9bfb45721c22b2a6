"""Selection by verified quotes: spans of the original text, one retry, budget and manifest; samples and running totals."""

import re

import pytest
from pairwright.functions import text as T
from pairwright.operators import analytics, selectors
from pyspark.sql import functions as F


def first_span(text, quote):
    norm, at = [], []
    for m in re.finditer(r"\s+|\S", text.rstrip()):
        if m.start() or not m[0].isspace():
            norm.append(" " if m[0].isspace() else m[0])
            at.append(m.start())
    q = " ".join(quote.split())
    k = "".join(norm).find(q)
    return None if len(q) < 8 or k < 0 else (at[k], at[k + len(q) - 1] + 1)


@pytest.mark.parametrize("text,quote", [
    ("The  quick\n\tbrown fox. The quick brown fox", "quick brown fox"), ("  lead in (a+b)*[c] \\E $x^ y.", "(a+b)*[c] \\E $x^"), ("x 漢字🙂🙂  über  Öl café", "🙂🙂 über Öl"), ("abc def", "abc def ghi"), ("short ab", "ab"),
    ("one two one  two three", "one two three"), ("a.c abc xyz a.c xyz", "a.c xyz "), ("", "anything at all"), ("nbsp here now", "nbsp here now"), ("pipe|pipe {3} it's", "pipe|pipe {3} it's"),
])
def test_spans_of_the_original(spark, text, quote):
    got = spark.createDataFrame([(text, quote)], "t string, q string").select(T.verified_span(F.col("t"), F.col("q")).alias("s"), F.col("t")).first()
    want = first_span(text, quote)
    assert (None if got["s"] is None else tuple(got["s"])) == want


def run(spark, docs, answers, retries, cap=3.0):
    return selectors.rescue(
        spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(answers, "doc bigint, item int, plain string, technical string, tokens_in bigint, tokens_out bigint, error string"),
        spark.createDataFrame(retries, "doc bigint, item int, role string, quote string, tokens_in bigint, tokens_out bigint"), ["doc"], cap,
    )


def test_rescue(spark):
    docs = [(1, "We have no evidence\n of access. The attacker used a stolen token."), (2, "Your data is safe today. A bug in the parser."), (3, "Nothing to say here"), (4, None), (5, "Your data  is safe today. The key leaked out."), (6, "later text of all")]
    answers = [
        (1, 0, "no evidence of access", "used a stolen token", 1000, 100, None), (1, 1, "no evidence whatsoever", "used a stolen token", 1000, 100, None), (1, 7, "no evidence of access", "used a stolen token", 1000, 100, None),
        (2, 0, "Your data is safe today", "A bug in a parser", 1000, 100, None), (3, None, None, None, 500, 10, "timeout"), (4, 0, "what is not there", None, 10, 1, None),
        (5, 0, "Your data is safe today", "The key leaked out", 1000, 100, None),
    ]
    retries = [(1, 1, "plain", "no such thing either", 50, 5), (2, 0, "technical", "A bug in the parser", 50, 5), (2, 0, "plain", "never asked for this", 50, 5), (4, 0, "plain", "what is not there", 50, 5)]
    pairs, manifest = run(spark, docs, answers, retries)
    assert sorted((r["doc"], r["item"], r["plain"], r["technical"]) for r in pairs.collect()) == [(1, 0, "no evidence\n of access", "used a stolen token"), (2, 0, "Your data is safe today", "A bug in the parser")]
    got = {r["doc"]: (r["status"], r["calls"], r["attempts"], r["first_try_ok"], r["retry_calls"], r["retry_saved"], r["failures"], r["pairs_emitted"], r["pairs_dedup_skipped"]) for r in manifest.collect()}
    assert got == {
        1: ("ok", 2, 4, 3, 1, 0, 1, 1, 0), 2: ("ok", 2, 2, 1, 1, 1, 0, 1, 0), 3: ("error", 1, 0, 0, 0, 0, 0, 0, 0), 4: ("ok", 2, 2, 0, 1, 0, 2, 0, 0), 5: ("ok", 1, 2, 2, 0, 0, 0, 0, 1), 6: ("pending", 0, 0, 0, 0, 0, 0, 0, 0),
    }
    pairs, manifest = run(spark, docs, answers, retries, cap=0.0009)  # the first document costs 840 millionths, the second passes the cap
    assert {r["doc"]: r["status"] for r in manifest.collect()} == {1: "ok", 2: "ok", 3: "budget_stop", 4: "budget_stop", 5: "budget_stop", 6: "budget_stop"}
    assert manifest.where("status = 'budget_stop'").agg(F.sum("calls"), F.sum("cost_usd")).first()[:] == (0, 0.0) and pairs.count() == 2
    none, empty = run(spark, [], [], [])
    assert none.count() == 0 and empty.count() == 0


def test_select_spans(spark):
    lead = "A worm spreads by  mail.\nIt infects hosts. Many were hit."
    wiki = lead + "\n== History ==\nmail mail worm\n== Mechanism ==\nnothing much\n=== Behaviour ===\nworm spreads mail infects\n== Details ==\nhosts infects\n"
    docs = spark.createDataFrame([(1, wiki), (2, wiki), (3, lead), (4, None), (5, wiki)], "doc int, text string")
    quotes = lambda rows: spark.createDataFrame(rows, "doc int, kind string, quote string")
    answers = quotes([(1, "mechanism", "spreads by mail. It infects"), (1, "mechanism", "It infects hosts."), (1, "impact", "Many were hit"), (2, "mechanism", "spread by mail"), (2, "impact", "Many were hit"), (3, "mechanism", "A worm spreads"), (5, "mechanism", "spread by mail")])
    retries = quotes([(1, "mechanism", "A worm spreads"), (2, "mechanism", "A worm spreads"), (2, "mechanism", "Many were hit")])
    got = {r["doc"]: r for r in selectors.select_spans(docs, answers, retries).collect()}
    assert {d: (r["status"], r["retried"], r["returned"], r["verified"]) for d, r in got.items()} == {1: ("ok", False, 3, 3), 2: ("ok", True, 2, 1), 3: ("no_tech_section", False, 1, 1), 4: ("no_mechanism_verified", False, 0, 0), 5: ("no_mechanism_verified", True, 1, 0)}
    assert got[1]["passage"] == "spreads by  mail.\nIt infects hosts." and [tuple(s) for s in got[1]["spans"]] == [(7, 35), (25, 42)]
    assert got[2]["passage"] == "A worm spreads Many were hit"
    assert got[1]["heading"] == "Mechanism" and got[1]["section"].startswith("== Mechanism ==") and "Behaviour" in got[1]["section"] and "Details" not in got[1]["section"]


def test_running_total(spark):
    rows = [(k % 5 if k % 3 else 2, k, None if k % 7 == 0 else k) for k in range(3000)]
    table = spark.createDataFrame(rows, "day int, id int, cost bigint").repartition(6)
    want, total = {}, 0
    for _, k, c in sorted(rows, key=lambda r: r[:2]):
        total += c or 0
        want[k] = total
    for ranges in (1, 7, 40):
        out = analytics.running_total(table, ["day", "id"], "cost", ranges=ranges)
        assert {r["id"]: r["spent"] for r in out.collect()} == want
    plan = analytics.within_budget(table, ["day", "id"], "cost", 1000)
    assert plan.where("paid").count() == sum(v <= 1000 for v in want.values()) and plan.columns == ["day", "id", "cost", "spent", "paid"]
    assert analytics.running_total(table.limit(0), ["day", "id"], "cost").count() == 0


def test_samples_and_made_negatives(spark):
    rows = [(k, ["a", "b", None][k % 3], f"g{k % 4}", f"text {k % 11}", f"draft {k}") for k in range(500)] + [(900, "c", "alone", "only", "d")]
    table = spark.createDataFrame(rows, "id int, kind string, g string, s string, d string")
    one, two = (sorted(r["id"] for r in analytics.sample_by_class(table.repartition(n), "kind", "id", 9, 42).collect()) for n in (2, 11))
    assert one == two and len(one) == 28
    assert one != sorted(r["id"] for r in analytics.sample_by_class(table, "kind", "id", 9, 43).collect())
    texts = table.withColumn("id", F.col("id").cast("string"))
    wrong = analytics.made_negatives(texts.where("id < 60 or id = '900'"), texts, "g", "id", "s", "d", 1).collect()
    source = {str(k): (g, s, d) for k, _, g, s, d in rows}
    assert len(wrong) == 59 + 1  # ids below 60 as text, but for the group that has no other
    for r in wrong:
        g, s, d = source[r["id"].removesuffix("-NEG")]
        assert r["s"] != s and r["d"] == d and r["g"] == g and any(x[2] == g and x[3] == r["s"] for x in rows)
