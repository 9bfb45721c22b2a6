"""What is not asked for is not looked for, and what two results need is found once."""

from pairwright.operators import checks, evidence
from pyspark.sql import functions as F

SRC = "Severity high. CVE-2024-12345 affects 5,678 hosts. An attacker could read records."


def test_base_beside_all_flags(spark):
    rows = spark.createDataFrame([(SRC, "It reads data.", "claim_inflation"), ("Critical at 10.2.3.4", SRC, None)], "s string, d string, target string")
    got = checks.judge(rows, "s", "d", target="target", base="base").orderBy(F.desc("s")).collect()
    plain = checks.judge(rows, "s", "d").orderBy(F.desc("s")).collect()
    assert [r.flags for r in got] == [r.flags for r in plain] and [r.base for r in got] == [[], []]


def test_measures_that_do_not_apply(spark):
    """A draft with business words for practitioners: the measure of leaders neither applies nor holds."""
    m = evidence.measures(F.lit("x"), F.lit("the business"), F.lit("practitioner"), F.lit("High"), F.lit("other"), F.lit(False))
    rows = spark.range(1).select(F.explode(m).alias("m")).select("m.*").collect()
    assert [(r.applies, r.holds) for r in rows if r.measure == "business"] == [(False, False)]
    assert not any(r.holds for r in rows if not r.applies)
