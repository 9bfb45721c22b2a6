from pairwright.operators import checks, extract
from pyspark.sql import functions as F

NUMBERED = """# Executive Summary
The review found problems. The parser is weak in several places (TOB-APP-1). This also affects the login flow (TOB-APP-2, TOB-APP-3).

Nothing else of note was seen here at all.
# Project Goals
Ignore TOB-APP-1 in this section please.
# Summary of Findings
| 1 | Parser trusts input | Data | High |
| 2 | Login is not limited | Auth | Medium |
| 3 | Secrets in the log file | Config | Low |
| 4 | Missing box title here | Config | Low |
# Detailed Findings
## 1. Parser trusts input
The parser reads any file.
1. Not a finding but a list item
2. Another step of the list
2. Login is not limited
Anyone can try passwords.
| 3. Secrets in the log file | 3. Secrets in the log file |
Keys are logged.
Missing box title here
| Severity: Low | Finding ID: TOB-APP-4 |
Box body.
# Appendix A
Out of scope.
"""
BY_ID = """# Findings
### ABC-01-001 Weak hash used (High)
MD5 is used.
### ABC-01-002 Open port (Low)
Port 22 is open.
# Conclusions
The hash of ABC-01-001 must be replaced soon by the team. Nothing else matters much in this part.
- ABC-01-001 and ABC-01-002 are fixed
"""


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc string, text string")


def test_numbered_findings_and_candidates(spark):
    table = docs(spark, r=NUMBERED, empty="", plain="no headings")
    found = extract.numbered_findings(table).cache()
    got = {r["number"]: (r["title"], r["severity"], r["text"]) for r in found.collect()}
    assert {n: v[1] for n, v in got.items()} == {1: "High", 2: "Medium", 3: "Low", 4: "Low"}
    assert got[1][2].startswith("The parser reads") and "Anyone can try" in got[2][2] and "Not a finding" in got[1][2]
    assert got[3][2] == "Keys are logged." and "Box body." in got[4][2] and "Out of scope" not in got[4][2]
    pairs = {r["pair_id"]: r for r in extract.numbered_candidates(table, found).collect()}
    assert sorted((r["finding_numbers"][0], r["alignment_type"]) for r in pairs.values()) == [(1, "1:1"), (2, "1:N"), (3, "1:N")]
    long = next(r["executive_text"] for r in pairs.values() if r["finding_numbers"] == [2])
    assert long.startswith("The parser is weak") and "This also affects" in long
    flat = " ".join(NUMBERED.split())
    assert all(r["technical_text"].split("\n\n", 1)[1] in NUMBERED and " ".join(r["executive_text"].split(". ")[0].split()) in flat for r in pairs.values())


def test_id_findings_and_candidates(spark):
    table = docs(spark, c=BY_ID)
    found = extract.id_findings(table)
    assert {(r["fid"], r["severity"], r["text"]) for r in found.collect()} == {("ABC-01-001", "High", "MD5 is used."), ("ABC-01-002", "Low", "Port 22 is open.")}
    got = sorted((r["cited_ids"], r["exec_span_kind"], r["alignment_type"]) for r in extract.id_candidates(table, found).collect())
    assert got == [(["ABC-01-001"], "prose", "1:1"), (["ABC-01-001", "ABC-01-002"], "bullet_list", "1:N"), (["ABC-01-001", "ABC-01-002"], "bullet_list", "1:N")]


def test_sections_claims_and_paragraphs(spark):
    table = docs(spark, a="# Summary\n" + "x" * 250 + "\n# Details\n" + "y" * 300 + "\n# End", b="# Summary\nshort\n# Details\n" + "y" * 300)
    assert [r["doc"] for r in extract.section_pairs(table, "(?i)^summary$", "(?i)^details$").collect()] == ["a"]
    claims = spark.createDataFrame([("d", 1, "The password database leaked customer records"), ("d", 2, "Nothing alike")], "doc string, claim int, text string")
    targets = spark.createDataFrame([("d", 7, "records of customer password database"), ("d", 8, "customer records database leaked password twice"), ("e", 9, "password database leaked customer records")], "doc string, target int, text string")
    assert [(r["claim"], r["target"], r["score"]) for r in extract.best_match(claims, targets).collect()] == [(1, 8, 5)]
    paras = spark.createDataFrame([("d", 1, "s", "fact one"), ("d", 2, "s", "fact two"), ("d", 3, "s", "As paragraphs 1 to 2, 5 and 3 show, it was unlawful")], "doc string, num int, section string, text string")
    cited = extract.cited_paragraphs(paras)
    assert [(r["citing"], r["cited"], r["technical_text"]) for r in cited.collect()] == [(3, [1, 2], "fact one\n\nfact two")]
    assert extract.same_section(paras, F.col("num") == 3, cited).count() == 0


def test_absorbed_and_cuts(spark):
    lost = spark.createDataFrame([("d", 4), ("d", 12)], "doc string, number int")
    there = spark.createDataFrame([("d", 1), ("d", 3), ("d", 5)], "doc string, number int")
    assert {(r["number"], r["host"]) for r in extract.absorbed_units(lost, there).collect()} == {(4, 3), (12, None)}
    cuts = spark.createDataFrame([("d", 1, 2, 100, 1000), ("d", 1, 3, 500, 1000), ("d", 9, 10, 500, 1000), ("d", 9, 11, 400, 1000)], "doc string, host int, number int, at int, stop int")
    assert {r["host"]: r["valid"] for r in extract.valid_cuts(cuts).collect()} == {1: True, 9: False}


def test_negatives_and_mutants(spark):
    pairs = spark.createDataFrame([("p1", "d", "t1", "e1", [1]), ("p2", "d", "t2", "e2", [2]), ("p3", "d", "t3", "e1", [3])], "pair_id string, source_doc_id string, technical_text string, executive_text string, finding_numbers array<int>")
    got = {r["pair_id"]: r["executive_text"] for r in extract.negatives(pairs).collect()}
    assert got == {"p1": "e2", "p2": "e1", "p3": "e2"}
    src = "Critical flaw CVE-2024-1234 on 77 hosts, only if debug is on."
    one = spark.createDataFrame([(1, src, "A critical flaw on 77 hosts.")], "id int, source_text string, draft_text string")
    rows = extract.mutants(one).withColumnRenamed("draft_text", "_d")
    bad = checks.judge(rows, draft="mutant", declared="severity_mutant").select("cls", "target", F.expr("exists(flags, f -> f.check = target and f.level = 'fail')").alias("hit"))
    assert {r["cls"]: r["hit"] for r in bad.collect()} == {"id_swap": True, "number_shift": True, "entity_invent": True, "severity_down": True, "caveat_delete": True}
