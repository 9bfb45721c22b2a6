"""Queries of the genre checks and document validation over conversations and documents, with small lists of our own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genre, validation
from .pairs import table

Query = Callable[[SparkSession, str], DataFrame]


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").where("role = 'assistant'")
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("conv_id") % 2 == 0, "S01").otherwise("S02").alias("situation"), F.lit(None).cast("string").alias("jurisdiction"), F.col("text").alias("draft"))


def genres(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("S01", True), ("S02", False)], "situation string, published boolean")


def lists(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, jargon and constants of two situations."""
    questions = spark.createDataFrame([("S01", "When was it fixed?", True), ("S01", "How many hosts are affected?", True), ("S02", "Which CVE is it?", True), ("S02", "Why does it matter?", True), ("S02", "When is it due?", False)], "situation string, question string, mandatory boolean")
    jargon = spark.createDataFrame([("S01", "of the", "literal", ["of the"], "plain", None), ("S01", "ion words", "conditional", [r"tion\."], "regex", "if unexplained"), ("S02", "tone", "conceptual", [], "plain", "needs a reader"), ("S02", "and", "literal", ["and."], "plain", None)], "situation string, term string, kind string, patterns array<string>, pattern_kind string, condition string")
    constants = spark.createDataFrame([("S01", "short", "length", "50 words", "words", 50.0, True, None), ("S01", "clock", "clock", "72 hours", None, None, None, None), ("S02", "parts", "fields", "", None, None, None, ["What the", "Erer and thent"]), ("S02", "pages", "length", "2 pages", "pages", 2.0, True, None)], "situation string, rule string, kind string, value string, unit string, most double, measurable boolean, fields array<string>")
    return questions, jargon, constants


def reader_questions(spark: SparkSession, folder: str) -> DataFrame:
    questions, _, _ = lists(spark)
    return genre.reader_questions(drafts(spark, folder), genres(spark), questions)


def prohibited_jargon(spark: SparkSession, folder: str) -> DataFrame:
    _, jargon, _ = lists(spark)
    out = genre.prohibited_jargon(drafts(spark, folder), genres(spark), jargon)
    return out.select("id", "check", "outcome", "item", F.length("evidence").cast("bigint").alias("n_chars"))


def format_constants(spark: SparkSession, folder: str) -> DataFrame:
    _, _, constants = lists(spark)
    return genre.format_constants(drafts(spark, folder), genres(spark), constants)


def doc_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("md"), F.lit(1).alias("n_pages"), F.array(F.struct(F.lit(3).alias("num_cols"), F.lit(4).alias("num_rows"), (F.col("doc_id") % 10 / 10.0).alias("empty_cell_frac"))).alias("table_stats"))
    words = table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    out = validation.validate(docs, words, "doc_id")
    return out.select("doc_id", "dict_ratio", "chars_per_page", F.col("checks")["chars_per_page_ok"].alias("length_ok"), F.col("checks")["tables_ok"].alias("tables_ok"), "passed")


QUERIES: dict[str, Query] = {f.__name__: f for f in (reader_questions, prohibited_jargon, format_constants, doc_quality)}

_D = "d AS (SELECT conv_id || '/' || turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'S01' ELSE 'S02' END AS s, text FROM conversations WHERE role = 'assistant')"
_M = "january|february|march|april|may|june|july|august|september|october|november|december"
ORACLE: dict[str, str] = {
    "reader_questions": rf"""WITH {_D}, q AS (SELECT * FROM (VALUES ('S01', 'When was it fixed?', 'date'), ('S01', 'How many hosts are affected?', 'quantity'), ('S02', 'Which CVE is it?', 'identifier'), ('S02', 'Why does it matter?', 'none')) AS x(s, item, kind)),
        e AS (SELECT id, s, item, CASE WHEN kind = 'date' AND NOT regexp_matches(text, '(?i)\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{1,2}}\s+({_M})|({_M})\s+[0-9]{{1,2}}|[0-9]+\s+(hours?|days?|weeks?|months?|business days?))\b') THEN 'no date or duration in the draft'
        WHEN kind = 'quantity' AND NOT regexp_matches(text, '\b[0-9][0-9,.]*\s*(%|percent)?\b') THEN 'no number in the draft' WHEN kind = 'identifier' AND NOT regexp_matches(text, '(?i)\b(CVE-[0-9]{{4}}-[0-9]{{4,7}}|CWE-[0-9]+|GHSA-[\w-]+|ICSA-[\w-]+)\b') THEN 'no identifier in the draft' ELSE '' END AS evidence FROM d JOIN q USING (s))
        SELECT id, 'reader_questions' AS "check", CASE WHEN evidence = '' THEN 'undecided' WHEN s = 'S01' THEN 'fail' ELSE 'warn' END AS outcome, item, evidence FROM e""",
    "prohibited_jargon": r"""WITH """ + _D + r""", h AS (SELECT id, s, text, item, hit, kind, CASE WHEN hit <> '' THEN instr(text, hit) END AS p FROM (
        SELECT id, s, text, 'of the' AS item, regexp_extract(text, '(?i)\bof the\b') AS hit, 'literal' AS kind FROM d WHERE s = 'S01' UNION ALL SELECT id, s, text, 'ion words', regexp_extract(text, '(?i)tion[.]'), 'conditional' FROM d WHERE s = 'S01'
        UNION ALL SELECT id, s, text, 'and', regexp_extract(text, '(?i)\band[.]'), 'literal' FROM d WHERE s = 'S02') WHERE hit <> ''),
        p AS (SELECT *, CASE item WHEN 'of the' THEN length(regexp_extract(text, '(?is)^(.*?)\bof the\b', 1)) WHEN 'and' THEN length(regexp_extract(text, '(?is)^(.*?)\band[.]', 1)) ELSE length(regexp_extract(text, '(?is)^(.*?)tion[.]', 1)) END + 1 AS pos FROM h),
        c AS (SELECT *, greatest(pos - 34, 1) AS a, least(pos + length(hit) + 34, length(text) + 1) AS z FROM p)
        SELECT id, 'prohibited_jargon' AS "check", CASE WHEN kind = 'conditional' THEN 'undecided' WHEN s = 'S01' THEN 'fail' ELSE 'warn' END AS outcome, item, CASE WHEN a > 1 THEN 3 ELSE 0 END + length(trim(regexp_replace(substr(text, a, z - a), '\s+', ' ', 'g'))) + CASE WHEN z <= length(text) THEN 3 ELSE 0 END AS n_chars FROM c
        UNION ALL SELECT id, 'prohibited_jargon', 'undecided', 'tone', length('needs a reader') FROM d WHERE s = 'S02'""",
    "format_constants": rf"""WITH {_D}, w AS (SELECT id, s, text, len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''-]*')) AS n, contains(regexp_replace(lower(text), '\s+', ' ', 'g'), 'what the') AS f1, (CAST(contains(lower(text), 'erer') AS INTEGER) + CAST(contains(lower(text), 'thent') AS INTEGER)) / 2 >= 0.6 AS f2 FROM d)
        SELECT id, 'format_constants' AS "check", 'fail' AS outcome, 'short' AS item, n || ' words against 50' AS evidence FROM w WHERE s = 'S01' AND n > 50 UNION ALL SELECT id, 'format_constants', 'declared', 'clock', '72 hours' FROM w WHERE s = 'S01'
        UNION ALL SELECT id, 'format_constants', 'declared', 'pages', '2 pages' FROM w WHERE s = 'S02' UNION ALL SELECT id, 'format_constants', 'warn', 'parts', array_to_string(list_filter([CASE WHEN NOT f1 THEN 'What the' END, CASE WHEN NOT f2 THEN 'Erer and thent' END], lambda x: x IS NOT NULL), '|') FROM w WHERE s = 'S02' AND NOT (f1 AND f2)""",
    "doc_quality": r"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM benchmark), t AS (SELECT doc_id, text, unnest(regexp_extract_all(lower(regexp_replace(text, '[#|*`\-]', ' ', 'g')), '[a-z]{2,}')) AS word FROM documents),
        r AS (SELECT doc_id, count(k.word) / count(*) AS ratio FROM t LEFT JOIN k USING (word) GROUP BY 1), x AS (SELECT doc_id, text, coalesce(ratio, 0) AS ratio, length(text) AS cpp, doc_id % 10 / 10.0 < 0.6 AS tables_ok FROM documents LEFT JOIN r USING (doc_id))
        SELECT doc_id, round(ratio, 6) AS dict_ratio, CAST(cpp AS DOUBLE) AS chars_per_page, cpp BETWEEN 400 AND 8000 AS length_ok, tables_ok, false AS passed FROM x""",
}
