"""Queries of the fidelity checks over ``finding_pairs`` and ``talk_pairs``, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, checks, report
from .pairs import FINDING_PAIRS_SQL, TALK_PAIRS_SQL, finding_pairs, table, talk_pairs

Query = Callable[[SparkSession, str], DataFrame]
SRC, DRAFT, NOTHING = "source_text", "draft_text", F.lit

_EVIDENCE = "array_join(evidence, '|')"


def _flags(build: Callable[[Column, Column], Column], pairs: Query = finding_pairs) -> Query:
    """A row per flag: ``pair_id``, ``level``, ``evidence``."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = pairs(spark, folder).select("pair_id", F.explode(build(F.col(SRC), F.col(DRAFT))).alias("f"))
        return rows.select("pair_id", "f.level", F.array_join("f.evidence", "|").alias("evidence"))

    return query


def _no() -> Column:
    return F.lit(None).cast("array<string>")


def judge_report(spark: SparkSession, folder: str) -> DataFrame:
    judged = checks.judge(finding_pairs(spark, folder))
    return judged.select("pair_id", "variant", F.size("flags").alias("n_flags"), F.array_join(T.sorted_set(F.transform("flags", lambda f: F.concat(f["check"], F.lit(":"), f["level"]))), ",").alias("found"), "ok")


def judge_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per check and level, how many pairs have such a flag."""
    judged = checks.judge(finding_pairs(spark, folder)).select("pair_id", F.explode_outer("flags").alias("f"))  # outer: the flags' size would be a filter, and worked out again in it
    return judged.where("f is not null").select("pair_id", "f.check", "f.level").distinct().groupBy("check", "level").agg(F.count("*").alias("n_pairs"))


def axis_report(spark: SparkSession, folder: str) -> DataFrame:
    """Fails and warnings by check's dimension and axis, for situation S01."""
    judged = checks.judge(finding_pairs(spark, folder)).select("pair_id", "flags")
    return report.axes(judged, "pair_id").groupBy("axis").agg(F.sum("fails").alias("fails"), F.sum("warns").alias("warns"), F.countDistinct("pair_id").alias("n_pairs"))


#: The planted error of each variant, and the check that it is aimed at.
AIMED = {1: "id_parity", 2: "numeric_parity", 3: "severity_drift", 4: "severity_drift", 5: "severity_drift", 6: "caveat_parity", 7: "claim_inflation", 8: "status_drift", 9: "entity_check"}


def aimed_check(variant: Column) -> Column:
    """The check that a variant's planted error is aimed at; null for one without an error."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in AIMED.items() for x in (k, v)]), variant)


def mutation_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How often each of the nine planted errors is found by the check that it is aimed at, also those that never are; an inflated severity also by the check of both directions.

    A pair counts only if its faithful draft passes that check.
    """
    drafts = finding_pairs(spark, folder).where(F.col("variant").isin(*AIMED)).select("pair_id", "variant", aimed_check(F.col("variant")).alias("target"), SRC, DRAFT)
    inflated = drafts.where("variant = 4").withColumn("target", F.lit("severity_drift"))
    failed = lambda name: F.exists(name, lambda f: f["level"] == "fail")
    both = F.explode(F.array(F.struct(F.lit(True).alias("base"), failed("base_flags").alias("failed")), F.struct(F.lit(False).alias("base"), failed("flags").alias("failed")))).alias("d")
    tested = lambda rows, target, **how: checks.judge_one(rows, "target", base="base_flags", **how).select("pair_id", "variant", target.alias("target"), both).select("pair_id", "variant", "target", "d.*")
    rows = tested(drafts, F.col("target")).unionByName(tested(inflated, F.lit("severity_inflation"), both_ways=True))
    return analytics.planted_recall(rows, "pair_id", ["variant", "target"])


def sentence_review(spark: SparkSession, folder: str) -> DataFrame:
    rows = checks.sentence_rows(finding_pairs(spark, folder), "pair_id")
    return rows.select("pair_id", "n", "level", F.array_join("checks", ",").alias("checks"))


def format_lint(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.explode(checks.format_lint(F.col("text"), F.lit("email"), F.lit("management"))).alias("f"))
    return turns.select("conv_id", "turn", "f.level", F.array_join("f.evidence", "|").alias("evidence"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", T.let(s, lambda x: F.struct(F.size(x).cast("bigint").alias("n_sentences"), F.md5(F.array_join(x, "|")).alias("digest"))).alias("s")).select("doc_id", "s.*")


def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return talk_pairs(spark, folder).select("conv_id", "turn", F.round(T.token_overlap(F.col(SRC), F.col(DRAFT)), 6).alias("overlap"))


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    t = T.index_terms(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", T.let(t, lambda x: F.struct(F.size(x).cast("bigint").alias("n_terms"), F.size(F.array_distinct(x)).cast("bigint").alias("n_distinct"))).alias("s")).select("doc_id", "s.*")


def shingles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", F.size(T.word_shingles(F.col("text"), 3, "[a-z0-9]+")).cast("bigint").alias("n_shingles"))


def extract_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", T.sorted_set(T.matches(F.col("text"), T.IP_PATTERN)).alias("e"))
    return rows.where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("addresses"))


def pii_flag(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", (~T.has_email(F.col("text"))).alias("pii_scrubbed"))


def mojibake_stats(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.regexp_count("text", F.lit("�|Ã.|â€"))
    return table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(broken).cast("bigint").alias("n_broken"), F.sum(F.length("text")).alias("n_chars"))


def caveat_markers(spark: SparkSession, folder: str) -> DataFrame:
    return finding_pairs(spark, folder).select("pair_id", F.array_join(checks.caveat_clauses(F.col(SRC)), "|").alias("clauses"))


QUERIES: dict[str, Query] = {
    "id_parity": _flags(lambda s, d: checks.id_parity(s, d, _no())),
    "numeric_parity": _flags(lambda s, d: checks.numeric_parity(s, d, _no())),
    "severity_drift": _flags(lambda s, d: checks.severity_drift(s, d, F.lit(None).cast("string"))),
    "severity_inflation": _flags(lambda s, d: checks.severity_drift(s, d, F.lit(None).cast("string"), both_ways=True)),
    "entity_check": _flags(lambda s, d: checks.entity_check(s, d, _no())),
    "caveat_parity": _flags(lambda s, d: checks.caveat_parity(s, d, _no())),
    "claim_inflation": _flags(checks.claim_inflation),
    "status_drift": _flags(checks.status_drift),
    "negation_flip": _flags(checks.negation_flip),
    "judge_report": judge_report,
    "judge_summary": judge_summary,
    "axis_report": axis_report,
    "mutation_recall": mutation_recall,
    "sentence_review": sentence_review,
    "format_lint": format_lint,
    "sentence_split": sentence_split,
    "token_overlap": token_overlap,
    "tokenize": tokenize,
    "shingles": shingles,
    "extract_entities": extract_entities,
    "pii_flag": pii_flag,
    "mojibake_stats": mojibake_stats,
    "caveat_markers": caveat_markers,
}

_FP = f"WITH {FINDING_PAIRS_SQL}"
_BAND = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END"

#: Flags of each check on the generated pairs, worked out from the texts by SQL of its own.
_FLAG_SQL = {
    "id_parity": """SELECT pair_id, 'fail' AS level, array_to_string(list_sort(lost), '|') AS evidence FROM (
        SELECT pair_id, list_filter(list_distinct(regexp_extract_all(source_text, 'CVE-[0-9]{4}-[0-9]{4,7}')), lambda x: NOT list_contains(regexp_extract_all(draft_text, 'CVE-[0-9]{4}-[0-9]{4,7}'), x)) AS lost FROM finding_pairs) WHERE len(lost) > 0""",
    "numeric_parity": """SELECT pair_id, 'fail' AS level, hosts AS evidence FROM (
        SELECT *, regexp_extract(source_text, ' affects ([0-9]+) hosts', 1) AS hosts FROM finding_pairs)
        WHERE NOT contains(draft_text, hosts) AND hosts NOT IN ('1', '2')""",
    "severity_drift": f"""SELECT pair_id, 'fail' AS level, 'source: ' || s || '|draft: ' || d AS evidence FROM sev WHERE {_BAND.format('d')} < {_BAND.format('s')}
        UNION ALL SELECT pair_id, 'warn', 'source: ' || s FROM sev WHERE d = ''""",
    "severity_inflation": f"""SELECT pair_id, 'fail' AS level, 'source: ' || s || '|draft: ' || d AS evidence FROM sev WHERE {_BAND.format('d')} <> {_BAND.format('s')}
        UNION ALL SELECT pair_id, 'warn', 'source: ' || s FROM sev WHERE d = ''""",
    "entity_check": """SELECT pair_id, level, e AS evidence FROM (
        SELECT pair_id, regexp_extract(source_text, '([0-9]{1,3}[.]){3}[0-9]{1,3}') AS s, regexp_extract(draft_text, '([0-9]{1,3}[.]){3}[0-9]{1,3}') AS d FROM finding_pairs) x,
        LATERAL (SELECT 'fail' AS level, d AS e UNION ALL SELECT 'warn', s) WHERE s <> d""",
    "caveat_parity": """SELECT pair_id, 'fail' AS level, 'There is no evidence of exploitation.' AS evidence FROM finding_pairs
        WHERE NOT contains(draft_text, 'no evidence of exploitation')""",
    "claim_inflation": """SELECT pair_id, 'fail' AS level, 'source hedge: could|draft: …' || trim(substr(draft_text, greatest(p - 24, 1), p + 22 - greatest(p - 24, 1))) || '…' AS evidence
        FROM (SELECT *, instr(draft_text, 'allows') AS p FROM finding_pairs) WHERE p > 0 AND NOT contains(draft_text, 'could')""",
    "status_drift": """SELECT pair_id, 'fail' AS level, 'draft: ' || regexp_extract(draft_text, '(?i)attackers? accessed') AS evidence FROM finding_pairs WHERE regexp_matches(draft_text, '(?i)attackers? accessed')""",
    "negation_flip": """SELECT pair_id, 'fail' AS level, 'draft: ' || regexp_extract(draft_text, '(?i)attackers? accessed') AS evidence FROM finding_pairs
        WHERE regexp_matches(draft_text, '(?i)attackers? accessed') AND regexp_matches(source_text, '(?i)no (evidence|indication|sign) of exploit')""",
}
_SEV_SQL = "sev AS (SELECT pair_id, regexp_extract(source_text, '^Severity ([a-z]+)', 1) AS s, regexp_extract(draft_text, '^Severity ([a-z]+)', 1) AS d FROM finding_pairs)"
_ALL_FLAGS = f"{_FP}, {_SEV_SQL}, flags AS (" + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", * FROM ({sql})" for name, sql in _FLAG_SQL.items() if name != "severity_inflation") + ")"



def _recall_sql() -> str:
    """The flags of the drafts, and those of the sources as drafts of themselves, for the rule that the base must pass."""
    aimed = ", ".join(f"({v}, '{c}', '{c}')" for v, c in AIMED.items()) + ", (4, 'severity_inflation', 'severity_inflation')"
    flags = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", * FROM ({sql})" for name, sql in _FLAG_SQL.items())
    base = flags.replace("finding_pairs", "base_pairs").replace("FROM sev", "FROM base_sev")
    return f"""{_FP}, {_SEV_SQL}, base_pairs AS (SELECT * REPLACE (source_text AS draft_text) FROM finding_pairs), base_{_SEV_SQL.replace("finding_pairs", "base_pairs")},
        flags AS ({flags}), base_flags AS ({base}), aimed AS (SELECT * FROM (VALUES {aimed}) AS x(variant, target, "check"))
        SELECT variant, target, count(*) AS n, count(*) FILTER (hit) AS n_found, round(count(*) FILTER (hit) / count(*), 6) AS recall
        FROM (SELECT variant, target, EXISTS (SELECT 1 FROM flags f WHERE f.pair_id = p.pair_id AND f."check" = a."check" AND level = 'fail') AS hit FROM finding_pairs p JOIN aimed a USING (variant)
              WHERE NOT EXISTS (SELECT 1 FROM base_flags f WHERE f.pair_id = p.pair_id AND f."check" = a."check" AND level = 'fail')) GROUP BY ALL"""


_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
_STOPS = "['the','a','an','of','to','and','in','is','that','this','for','on','be','by','it','as','with']"

ORACLE: dict[str, str] = {name: f"{_FP}, {_SEV_SQL} {sql}" for name, sql in _FLAG_SQL.items()} | {
    "judge_report": f"""{_ALL_FLAGS}
        SELECT pair_id, variant, coalesce(n, 0) AS n_flags, coalesce(found, '') AS found, coalesce(fails, 0) = 0 AS ok FROM finding_pairs LEFT JOIN
        (SELECT pair_id, count(*) AS n, string_agg(DISTINCT "check" || ':' || level, ',' ORDER BY "check" || ':' || level) AS found, count(*) FILTER (level = 'fail') AS fails FROM flags GROUP BY pair_id) USING (pair_id)""",
    "judge_summary": f"""{_ALL_FLAGS} SELECT "check", level, count(DISTINCT pair_id) AS n_pairs FROM flags GROUP BY ALL""",
    "axis_report": f"""{_ALL_FLAGS}, axes AS (SELECT * FROM (VALUES ('id_parity','F'),('numeric_parity','F'),('entity_check','F'),('severity_drift','F'),('claim_inflation','F'),('caveat_parity','F'),('status_drift','F'),('negation_flip','F'),('format_lint','U')) AS x("check", axis))
        SELECT a.axis, count(*) FILTER (level = 'fail') AS fails, count(*) FILTER (level = 'warn') AS warns, (SELECT count(*) FROM finding_pairs) AS n_pairs
        FROM (SELECT unnest(['F', 'U']) AS axis) a LEFT JOIN axes USING (axis) LEFT JOIN flags USING ("check") GROUP BY a.axis""",
    "mutation_recall": _recall_sql(),
    "sentence_review": rf"""{_FP}, s AS (SELECT pair_id, source_text, {_SENT.replace('text,', 'draft_text,', 1)} AS s FROM finding_pairs), x AS (SELECT pair_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS n FROM s)
        SELECT pair_id, n, CASE WHEN t LIKE '%allows reading%' OR t LIKE 'Attackers accessed%' THEN 'red' ELSE 'green' END AS level,
        CASE WHEN t LIKE '%allows reading%' THEN 'claim_inflation' WHEN t LIKE 'Attackers accessed%' THEN 'claim_inflation,negation_flip,status_drift' ELSE '' END AS checks FROM x""",
    "format_lint": r"""WITH w AS (SELECT conv_id, turn, text, len(regexp_extract_all(text, '\S+')) AS n FROM conversations),
        j AS (SELECT conv_id, turn, list_sort(list_filter(['ssrf','xss','csrf','rce','deserialization','endpoint','nonce','heap','buffer overflow','privilege escalation'], lambda t: contains(lower(text), t))) AS hits FROM conversations)
        SELECT conv_id, turn, 'fail' AS level, n || ' words' AS evidence FROM w WHERE n > 150 UNION ALL SELECT conv_id, turn, 'warn', array_to_string(hits, '|') FROM j WHERE len(hits) > 0""",
    "sentence_split": rf"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENT} AS s FROM documents)",
    "token_overlap": f"""WITH {TALK_PAIRS_SQL}, t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(source_text), '[a-z0-9'']+')) AS a, list_distinct(regexp_extract_all(lower(draft_text), '[a-z0-9'']+')) AS b FROM talk_pairs),
        k AS (SELECT conv_id, turn, b, list_filter(a, lambda x: NOT list_contains({_STOPS}, x)) AS a FROM t)
        SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS overlap FROM k""",
    "tokenize": "SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}') AS t FROM documents)",
    "shingles": """WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS n_shingles FROM w""",
    "extract_entities": r"SELECT doc_id, array_to_string(list_sort(list_distinct(e)), ',') AS addresses FROM (SELECT doc_id, regexp_extract_all(text, '\b(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\b') AS e FROM documents) WHERE len(e) > 0",
    "pii_flag": "SELECT doc_id, NOT regexp_matches(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+[.][\\p{L}\\p{N}_.]+') AS pii_scrubbed FROM documents",
    "mojibake_stats": "SELECT lang, count(*) AS n, CAST(sum(len(regexp_extract_all(text, chr(65533) || '|Ã.|â€'))) AS BIGINT) AS n_broken, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang",
    "caveat_markers": f"{_FP} SELECT pair_id, 'An attacker could read records only if the debug interface is enabled.|There is no evidence of exploitation.' AS clauses FROM finding_pairs",
}
