"""Texts of ASCII only are searched by patterns without Unicode classes: they must find what the same texts give with a letter beyond ASCII, and do it without the slow patterns."""

import pytest
from pairwright.functions import text as T
from pairwright.operators import checks
from pyspark.sql import functions as F

TEXTS = [
    "", " ", "Severity high. CVE-2024-12345 affects 5,678 hosts at 10.2.3.4. An attacker could read records only if it is on. There is no evidence of exploitation.",
    "cve-2020-1234 and TOB-CVE-1234-5678, ghsa-ab12-cd34-ef56, CWE-79; ICSA-21-123-01 tob-abc-1", "No evidence of critical impact. It is Critical, though.", "no evidence of critical impact and critical again",
    "High\nseverity, not high. exploited\nin the wild", "It was not exploited. It was exploited on Port 8080 and port  443.", "CVSS 9.8, critical", "V1.2.3 and v1.2.3 at WWW.Example.COM or a.b.co.uk; 999.1.1.1.1", "$1,234.50, 12 %, 2019, 1, 2, 3, $2019, 1.5%, -7 x8 9x",
    " a. b!\tc?  d\n\ne ", "It has been fixed. It is still vulnerable. Not yet patched", "Attackers accessed it; an attacker could, only when asked, read and write", "was not aware. were exploited", "informational\ncritical risk. low-severity", "No indication: an attacker could exploit. The an of.",
]


@pytest.fixture(scope="module")
def found(spark):
    """Each fact of each text as it is, and of the text with a sentence of a letter beyond ASCII behind it, that no fact but the sentences sees."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string").withColumn("far", F.concat("t", F.lit("\né")))
    names = ["identifiers", "numbers", "severity", "entities", "clauses", "hedges", "acts", "exploited", "exploitable", "remediated", "vulnerable", "sentences"]
    out, near = checks.Facts.bound(rows, F.col("t"), "_n_")
    out, far = checks.Facts.bound(out, F.col("far"), "_f_")
    return names, out.select("k", *[getattr(x, n).alias(f"{p}_{n}") for p, x in (("n", near), ("f", far)) for n in names]).orderBy("k").collect()


def test_same_facts(found):
    names, rows = found
    for r in rows:
        for n in names:
            far = r[f"f_{n}"]
            assert r[f"n_{n}"] == (far[:-1] if n == "sentences" else far), (TEXTS[r["k"]], n)


def test_ascii_patterns(spark):
    """The facts of an ASCII text have patterns without Unicode classes to go by."""
    plan = spark.range(1).select(F.lit("x").alias("t")).select(checks.Facts.of(F.col("t")).hedges.alias("h"))._jdf.queryExecution().analyzed().toString()
    assert checks.HEDGE.removeprefix("(?iU)") in plan.replace(checks.HEDGE, "")


def test_one_check_of_base_and_draft(spark):
    """``judge_one`` with ``base`` gives the flags of the source as a draft of itself, and all flags equal those of ``judge``."""
    rows = spark.createDataFrame([(a, b, c) for a in TEXTS[2:6] for b in TEXTS[2:8] for c in checks.CHECKS], "s string, d string, target string")
    one = checks.judge_one(rows, "target", "s", "d", base="base").select("s", "d", "target", "flags", "base").collect()
    pairs = rows.select("s", "d").union(rows.select("s", F.col("s"))).distinct()
    whole = {(r.s, r.d): r.flags for r in checks.judge(pairs, "s", "d").collect()}
    for r in one:
        assert r.flags == [f for f in whole[r.s, r.d] if f.check == r.target] and r.base == [f for f in whole[r.s, r.s] if f.check == r.target]


def test_sentence_rows(spark):
    rows = spark.createDataFrame([(k, TEXTS[2], t) for k, t in enumerate(TEXTS)], "id int, source_text string, draft_text string")
    got = {(r.id, r.n): (r.sentence, r.level, r.checks) for r in checks.sentence_rows(rows, "id").collect()}
    want = {(r.id, k): (x.sentence, x.level, x.checks) for r in rows.select("id", checks.sentence_levels(F.col("source_text"), F.col("draft_text")).alias("s")).collect() for k, x in enumerate(r.s)}
    assert got == want
