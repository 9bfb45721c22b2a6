"""Queries of the checks over sentences that differ by document: every family of identifiers, every kind of entity, every caveat marker, CVSS scores and words of severity, statements of status.

Each document has its parts by its id; SQL works out from the parts, not from the texts, what the checks have to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from .template_queries import SEEDS_SQL, seeds

Query = Callable[[SparkSession, str], DataFrame]

IDS = ("CVE-2023-10{d}", "CWE-{d}", "GHSA-ab{d}-cd34-ef56", "ICSA-23-1{d}-01", "TOB-APP-{d}", "DYL-WEB-{d}")
ENTITIES = ("10.20.30.{d}", "2.3.{d}", "app{d}.example.com", "port 80{d}")
#: (statement, what it says): of the source first, then of the draft.
SAID = (("An attacker could take the data", "possible"), ("The flaw has been fixed", "remediated"), ("The host is vulnerable", "vulnerable"), ("There is no evidence of exploitation", "none"), ("The weather is fine", ""))
TOLD = (("Attackers accessed the data", "exploited"), ("The host is still vulnerable", "vulnerable"), ("The flaw was patched", "remediated"), ("Attackers have not been seen", ""))
WORDS = (("critical", 4), ("high", 3), ("medium", 2), ("moderate", 2), ("low", 1), ("informational", 0), ("", None))


def _k() -> Column:
    return F.col("k")


def _no() -> Column:
    return F.lit(None).cast("array<string>")


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _two(values: tuple, n: Column) -> Column:
    """The value by number, with two digits of the id in it."""
    return F.replace(_pick(values, n), F.lit("{d}"), F.lpad((_k() % 90 + 10).cast("string"), 2, "0"))


def _flags(rows: DataFrame, flags: Column) -> DataFrame:
    return rows.select("k", F.explode(flags).alias("f")).select("k", "f.check", "f.level", F.array_join("f.evidence", "|").alias("evidence"))


def varied_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Two identifiers of any families in the source; the draft keeps both, one or none, or declares one as left out."""
    a, b = _two(IDS, _k()), _two(IDS, F.floor(_k() / 6))
    source = F.concat(F.lit("Seen as "), a, F.lit(" and also "), b, F.lit(" by all"))
    draft = F.when(_k() % 4 == 0, F.concat(F.lit("See "), a, F.lit(", "), b)).when(_k() % 4 == 1, F.concat(F.lit("See "), b)).otherwise("See the source")
    omitted = F.when(_k() % 4 == 3, F.array(F.concat(F.lit("left out: "), a))).otherwise(_no())
    return _flags(seeds(spark, folder), checks.id_parity(source, draft, omitted))


def varied_entities(spark: SparkSession, folder: str) -> DataFrame:
    """An entity of each kind in the source; the draft keeps it, drops it, invents another, or declares it as left out."""
    a, b = _two(ENTITIES, _k()), F.replace(_pick(ENTITIES, F.floor(_k() / 4)), F.lit("{d}"), F.lit("09"))
    source = F.concat(F.lit("The host at "), a, F.lit(" is open"))
    draft = F.when(_k() % 5 == 0, F.concat(F.lit("It is "), F.upper(a))).when(_k() % 5 == 1, "It is open").when(_k() % 5 == 2, F.concat(F.lit("It is "), b, F.lit(" now"))).when(_k() % 5 == 3, F.concat(F.lit("It is "), a, F.lit(" or "), b)).otherwise("Open")
    omitted = F.when(_k() % 5 == 4, F.array(a)).otherwise(_no())
    return _flags(seeds(spark, folder), checks.entity_check(source, draft, omitted))


def varied_caveats(spark: SparkSession, folder: str) -> DataFrame:
    """A condition with each of the markers in the source; the draft has it in like words, has it not, or declares it."""
    clause = F.concat(F.lit("Abuse of "), F.col("w"), F.lit(" in that case "), _pick(checks.CAVEAT_MARKERS, _k()), F.lit(" some further step"))
    source = F.concat(F.lit("The parser fails. First of all, "), clause, F.lit("; then it ends."))
    draft = F.when(F.floor(_k() / 25) % 3 == 0, F.concat(F.lit("The parser fails. Note: "), clause, F.lit("."))).otherwise("The parser fails.")
    omitted = F.when(F.floor(_k() / 25) % 3 == 1, F.array(clause)).otherwise(_no())
    return _flags(seeds(spark, folder), checks.caveat_parity(source, draft, omitted))


def varied_severity(spark: SparkSession, folder: str) -> DataFrame:
    """A CVSS score of the source against a word of the draft, for half of the documents the other way round; in both directions."""
    score, word = F.concat(F.lit("Its CVSS v3.1 base score of: "), F.round(_k() % 100 / 10, 1)), _pick(tuple(w for w, _ in WORDS), F.floor(_k() / 3))
    worded = F.concat(F.lit("We call it "), word)
    source, draft = F.when(_k() % 2 == 0, score).otherwise(worded), F.when(_k() % 2 == 0, worded).otherwise(score)
    found = checks.severity_drift(source, draft, F.lit(None).cast("string"), both_ways=True)
    return seeds(spark, folder).select("k", F.explode(found).alias("f")).select("k", "f.check", "f.level", F.size("f.evidence").cast("bigint").alias("n_evidence"))


def varied_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every statement of status in the source with every one in the draft: drift, and flips of what was denied."""
    source, draft = F.concat(_pick(tuple(s for s, _ in SAID), _k()), F.lit(".")), F.concat(_pick(tuple(s for s, _ in TOLD), F.floor(_k() / 5)), F.lit("."))
    found = F.concat(checks.status_drift(source, draft), checks.negation_flip(source, draft))
    return seeds(spark, folder).select("k", F.explode(found).alias("f")).select("k", "f.check", "f.level", F.size("f.evidence").cast("bigint").alias("n_evidence"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (varied_ids, varied_entities, varied_caveats, varied_severity, varied_status)}


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in values) + "]"


def _at(values: tuple, n: str) -> str:
    return f"{_list(values)}[{n} % {len(values)} + 1]"


_D = "CAST(k % 90 + 10 AS VARCHAR)"
_WORDS, _BANDS = tuple(w for w, _ in WORDS), tuple(b for _, b in WORDS)
ORACLE: dict[str, str] = {
    "varied_ids": f"""WITH {SEEDS_SQL}, i AS (SELECT k, replace({_at(IDS, 'k')}, '{{d}}', {_D}) AS a, replace({_at(IDS, 'k // 6')}, '{{d}}', {_D}) AS b FROM seeds),
        l AS (SELECT k, list_sort(list_distinct([upper(x) FOR x IN CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN CASE WHEN a = b THEN [] ELSE [a] END WHEN 2 THEN [a, b] ELSE CASE WHEN a = b THEN [] ELSE [b] END END])) AS lost FROM i)
        SELECT k, 'id_parity' AS "check", 'fail' AS level, array_to_string(lost, '|') AS evidence FROM l WHERE len(lost) > 0""",
    "varied_entities": f"""WITH {SEEDS_SQL}, e AS (SELECT k, replace({_at(ENTITIES, 'k')}, '{{d}}', {_D}) AS a, replace({_at(ENTITIES, 'k // 4')}, '{{d}}', '09') AS b FROM seeds)
        SELECT k, 'entity_check' AS "check", 'fail' AS level, b AS evidence FROM e WHERE k % 5 IN (2, 3) UNION ALL SELECT k, 'entity_check', 'warn', a FROM e WHERE k % 5 IN (1, 2)""",
    "varied_caveats": f"""WITH {SEEDS_SQL} SELECT k, 'caveat_parity' AS "check", 'fail' AS level, 'Abuse of ' || w || ' in that case ' || {_at(checks.CAVEAT_MARKERS, 'k')} || ' some further step' AS evidence FROM seeds WHERE (k // 25) % 3 = 2""",
    "varied_severity": f"""WITH {SEEDS_SQL}, b AS (SELECT k, CASE WHEN k % 100 >= 90 THEN 4 WHEN k % 100 >= 70 THEN 3 WHEN k % 100 >= 40 THEN 2 ELSE 1 END AS score, {_at(_BANDS, '(k // 3)')} AS word FROM seeds),
        p AS (SELECT k, CASE WHEN k % 2 = 0 THEN score ELSE word END AS s, CASE WHEN k % 2 = 0 THEN word ELSE score END AS d FROM b)
        SELECT k, 'severity_drift' AS "check", CASE WHEN d IS NULL THEN 'warn' ELSE 'fail' END AS level, CASE WHEN d IS NULL THEN 1 ELSE 2 END AS n_evidence FROM p WHERE s IS NOT NULL AND s IS DISTINCT FROM d""",
    "varied_status": f"""WITH {SEEDS_SQL}, p AS (SELECT k, {_at(tuple(x for _, x in SAID), 'k')} AS s, {_at(tuple(x for _, x in TOLD), '(k // 5)')} AS d FROM seeds)
        SELECT k, 'status_drift' AS "check", 'fail' AS level, 1 AS n_evidence FROM p WHERE s = 'possible' AND d = 'exploited' UNION ALL SELECT k, 'status_drift', 'fail', 2 FROM p WHERE s = 'remediated' AND d = 'vulnerable'
        UNION ALL SELECT k, 'status_drift', 'warn', 1 FROM p WHERE s = 'vulnerable' AND d = 'remediated' UNION ALL SELECT k, 'negation_flip', 'fail', 1 FROM p WHERE s = 'none' AND d = 'exploited'""",
}
