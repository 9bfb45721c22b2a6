"""The scenarios of the fidelity checks, one row each, and what each must find."""

import pytest
from pairwright.operators import checks, report
from pyspark.sql import functions as F

SRC = "Severity high. CVE-2024-12345 affects 5,678 hosts at 10.2.3.4. An attacker could read records only if the debug interface is enabled. There is no evidence of exploitation."
SCHEMA = "name string, source_text string, draft_text string, omitted array<string>, sev string, fmt string, aud string, fails array<string>, warns array<string>"
CASES = [
    ("faithful", SRC, SRC, [], None, None, None, [], []),
    ("nothing to keep", "All is fine", "Fine", [], None, None, None, [], []),
    ("identifier dropped", SRC, SRC.replace("CVE-2024-12345", "A flaw"), [], None, None, None, ["id_parity"], []),
    ("identifier declared", SRC, SRC.replace("CVE-2024-12345", "A flaw"), ["CVE-2024-12345"], None, None, None, [], []),
    ("house id dropped", "TOB-ABC-12 is low", "It is low", [], None, None, None, ["id_parity"], []),
    ("count dropped", SRC, SRC.replace("5,678", "many"), [], None, None, None, ["numeric_parity"], []),
    ("count declared", SRC, SRC.replace("5,678", "many"), ["5,678 hosts"], None, None, None, [], []),
    ("score dropped", "CVSS 9.8 critical flaw", "A critical flaw", [], None, None, None, ["numeric_parity"], []),
    ("softened", SRC, SRC.replace("high", "low"), [], None, None, None, ["severity_drift"], []),
    ("declared below", SRC, SRC, [], "low", None, None, ["severity_drift"], []),
    ("severity silent", SRC, SRC.replace("Severity high. ", ""), [], None, None, None, [], ["severity_drift"]),
    ("stronger than source", SRC, SRC.replace("high", "critical"), [], None, None, None, [], []),
    ("invented address", SRC, SRC + " See 8.8.8.8.", [], None, None, None, ["entity_check"], []),
    ("invented version", SRC, SRC + " Use v1.2.3.", [], None, None, None, ["entity_check"], []),
    ("address dropped", SRC, SRC.replace(" at 10.2.3.4", ""), [], None, None, None, [], ["entity_check"]),
    ("condition dropped", "It is exploitable only if debug is enabled.", "It is exploitable.", [], None, None, None, ["caveat_parity"], []),
    ("no-evidence clause dropped", SRC, SRC.replace(" There is no evidence of exploitation.", ""), [], None, None, None, ["caveat_parity"], []),
    ("no-evidence clause declared", SRC, SRC.replace(" There is no evidence of exploitation.", ""), ["There is no evidence of exploitation."], None, None, None, [], []),
    ("negated severity is none", "No evidence of critical impact", "Fine", ["No evidence of critical impact"], None, None, None, [], []),
    ("inflated", "An attacker could read data", "It reads data", [], None, None, None, ["claim_inflation"], []),
    ("happened", SRC, SRC.replace("There is no evidence of exploitation.", "Attackers accessed the records."), [], None, None, None, ["caveat_parity", "negation_flip", "status_drift"], []),
    ("still open", "The flaw was patched", "The flaw is still vulnerable", [], None, None, None, ["status_drift"], []),
    ("closed too early", "The flaw is not yet fixed", "The flaw was fixed", [], None, None, None, [], ["status_drift"]),
    ("too long", "x", "word " * 151, [], None, "email", None, ["format_lint"], []),
    ("five bullets", "x", "- a\n- b\n- c\n- d\n- e", [], None, "slide", None, ["format_lint"], []),
    ("three bullets", "x", "- a\n• b\n* c", [], None, "slide", None, [], []),
    ("jargon", "x", "An SSRF endpoint", [], None, None, "management", [], ["format_lint"]),
    ("jargon for engineers", "x", "An SSRF endpoint", [], None, None, "practitioner", [], []),
    ("nulls", None, None, None, None, None, None, [], []),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame(CASES, SCHEMA)
    return checks.judge(rows, omitted="omitted", declared="sev", contract="fmt", audience="aud").collect()


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_scenario(judged, k):
    r = next(x for x in judged if x["name"] == CASES[k][0])
    got = lambda level: sorted({f["check"] for f in r["flags"] if f["level"] == level})
    assert got("fail") == sorted(r["fails"]) and got("warn") == sorted(r["warns"])
    assert r["ok"] == (not r["fails"])
    assert all(f["evidence"] and all(f["evidence"]) for f in r["flags"])
    assert set(r["passed"]) == set(checks.CHECKS) - {f["check"] for f in r["flags"]}


def test_both_ways(spark):
    row = spark.createDataFrame([c for c in CASES if c[0] == "stronger than source"], SCHEMA)
    assert not checks.judge(row, both_ways=True).first()["ok"]


def test_unknown_keys(spark):
    out = spark.range(1).select(checks.unknown_keys(F.lit("memo"), F.lit("board")).alias("k")).first()["k"]
    assert list(out) == ["memo", "board"]


def test_axes_are_kept_apart(spark):
    rows = checks.judge(spark.createDataFrame(CASES, SCHEMA), omitted="omitted", declared="sev", contract="fmt", audience="aud")
    got = {(r["name"], r["axis"]): r for r in report.axes(rows, "name").collect()}
    assert got[("identifier dropped", "F")]["failed"] == ["D2"] and got[("identifier dropped", "F")]["invalid"]
    assert got[("identifier dropped", "U")]["fails"] == 0 and got[("too long", "U")]["failed"] == ["D8"]
    assert "D5" in got[("faithful", "F")]["unexamined"] and "D5" in got[("faithful", "U")]["unexamined"]
    assert report.weight_table(spark).count() == 88
