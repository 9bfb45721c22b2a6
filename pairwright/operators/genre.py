"""Genre checks: what a genre's readers must be told, what they must not have to read, and what form it has.

The lists are tables: questions(situation, question, mandatory, source), jargon(situation, term, kind, patterns,
pattern_kind, condition, why), constants(situation, rule, kind, value, unit, most, measurable, fields), and
genres(situation, published). Drafts have id, situation, jurisdiction and draft. Only a published checklist lets a
check fail; elsewhere it warns. What no rule can decide is reported as undecided, what is no matter of text as
declared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, matches, padded

# The traces that an answer must leave, and the words that do not tell fields apart.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SIGNALS = (
    ("date", r"\bwhen\b|\bdate\b|\btimeline\b|\bhow long\b|\bdeadline\b|\bby when\b",
     rf"(?i)\b(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}\s+({MONTHS})|({MONTHS})\s+\d{{1,2}}|\d+\s+(hours?|days?|weeks?|months?|business days?))\b",
     "no date or duration in the draft"),
    ("quantity", r"\bhow many\b|\bhow much\b|\bnumber of\b|\bcount\b|\bscope\b|\bhow far\b", r"\b\d[\d,.]*\s*(%|percent)?\b", "no number in the draft"),
    ("identifier", r"\bwhich (cve|identifier|advisory)\b|\bcve\b|\bidentifier\b", r"(?i)\b(CVE-\d{4}-\d{4,7}|CWE-\d+|GHSA-[\w-]+|ICSA-[\w-]+)\b", "no identifier in the draft"),
)
FIELD_STOPWORDS = (
    "what", "the", "we", "are", "is", "was", "and", "of", "to", "a", "an", "for", "your", "our", "you", "in", "on",
    "it", "that", "this", "be", "been", "has", "have", "will", "how", "why", "when", "who",
)
FIELD_SHARE, CONTEXT, PUBLIC_BREACH = 0.6, 34, "S06"


def _level(published: Column) -> Column:
    return F.when(published, "fail").otherwise("warn")


def applies(situation: Column, jurisdiction: Column, bound_to: Column) -> Column:
    """Entries bound to a jurisdiction apply to it alone, and only where the situation has any; the rest always."""
    return bound_to.isNull() | (situation != PUBLIC_BREACH) | jurisdiction.isNull() | (bound_to == jurisdiction)


def _joined(drafts: DataFrame, genres: DataFrame, table: DataFrame) -> DataFrame:
    bound = F.col("jurisdiction_bound") if "jurisdiction_bound" in table.columns else F.lit(None).cast("string")
    rows = drafts.join(genres, "situation").join(table, "situation")
    return rows.where(applies(F.col("situation"), F.col("jurisdiction"), bound))


def reader_questions(drafts: DataFrame, genres: DataFrame, questions: DataFrame) -> DataFrame:
    """(``id``, ``check``, ``outcome``, ``item``, ``evidence``) for each mandatory question: a flag where its literal trace is absent, else undecided."""
    rows = _joined(drafts, genres, questions.where("mandatory"))
    q, lost = F.lower("question"), F.lit(None).cast("string")
    for _, asks, trace, label in reversed(SIGNALS):
        lost = F.when(q.rlike(asks), F.when(~F.col("draft").rlike(trace), F.lit(label))).otherwise(lost)
    outcome = F.when(lost.isNotNull(), _level(F.col("published"))).otherwise("undecided")
    return rows.select("id", F.lit("reader_questions").alias("check"), outcome.alias("outcome"), F.col("question").alias("item"), F.coalesce(lost, F.lit("")).alias("evidence"))


def pattern_regex(pattern: Column, kind: Column) -> Column:
    """A pattern as a regular expression: plain ones quoted once, with word borders where they begin or end with a word character; ``regex`` ones as they are."""
    body = F.concat(F.lit("\\Q"), F.replace(F.trim(pattern), F.lit("\\E"), F.lit("")), F.lit("\\E"))
    left = F.when(F.trim(pattern).rlike("^[A-Za-z0-9]"), F.lit("\\b")).otherwise(F.lit(""))
    right = F.when(F.trim(pattern).rlike("[A-Za-z0-9]$"), F.lit("\\b")).otherwise(F.lit(""))
    return F.concat(F.lit("(?i)"), F.when(kind == "regex", pattern).otherwise(F.concat(left, body, right)))


def with_context(draft: Column, pattern: Column, pad: int = CONTEXT) -> Column:
    """The first match with the text around it, or null."""
    at, hit = F.regexp_instr(draft, pattern), F.regexp_substr(draft, pattern)

    def cut(a: Column, h: Column) -> Column:
        begin, end = F.greatest(a - pad, F.lit(1)), F.least(a + F.length(h) + pad, F.length(draft) + 1)
        middle = F.trim(F.regexp_replace(F.substr(draft, begin, end - begin), r"\s+", " "))
        return F.concat(F.when(begin > 1, "...").otherwise(""), middle, F.when(end <= F.length(draft), "...").otherwise(""))

    return F.when(hit.isNotNull(), let(at, lambda a: let(hit, lambda h: cut(a, h))))


def prohibited_jargon(drafts: DataFrame, genres: DataFrame, jargon: DataFrame) -> DataFrame:
    """One row per term found, by its first pattern that matches: literal ones flag, conditional ones are undecided; conceptual ones are always undecided."""
    rows = _joined(drafts, genres, jargon)
    hits = F.filter(F.transform("patterns", lambda p: with_context(F.col("draft"), pattern_regex(p, F.col("pattern_kind")))), lambda x: x.isNotNull())
    rows = rows.withColumn("hit", F.when(F.col("kind") != "conceptual", F.get(hits, F.lit(0))))
    outcome = F.when(F.col("kind") == "literal", _level(F.col("published"))).otherwise("undecided")
    return rows.where("kind = 'conceptual' or hit is not null").select("id", F.lit("prohibited_jargon").alias("check"), outcome.alias("outcome"), F.col("term").alias("item"), F.coalesce("hit", "condition", F.lit("")).alias("evidence"))


def count_unit(draft: Column, unit: Column) -> Column:
    """Words or sentences of the draft; null for units that only a rendered page has."""
    sentences = F.filter(F.split(draft, r"(?<=[.!?])\s+(?=[A-Z\"'(])"), lambda s: F.length(F.trim(s)) > 1)
    return F.when(unit == "words", F.size(matches(draft, r"[A-Za-z0-9][A-Za-z0-9'-]*"))).when(unit == "sentences", F.size(sentences))


def field_present(draft: Column, field: Column) -> Column:
    """Whether at least 60 % of the telling words of a field's name stand in the draft; the whole name, if it has none."""
    key = F.filter(matches(F.lower(field), "[a-z0-9']+"), lambda w: (F.length(w) > 2) & ~w.isin(*FIELD_STOPWORDS))
    hay = F.regexp_replace(F.lower(draft), r"\s+", " ")
    return let(key, lambda k: F.when(F.size(k) == 0, F.contains(hay, F.regexp_replace(F.lower(field), r"\s+", " "))).otherwise(F.size(F.filter(k, lambda w: F.contains(hay, w))) / F.size(k) >= FIELD_SHARE))


def format_constants(drafts: DataFrame, genres: DataFrame, constants: DataFrame) -> DataFrame:
    """Lengths over their limit and fields without trace flag; clocks, templates and what cannot be measured are declared."""
    rows = _joined(drafts, genres, constants)
    n = count_unit(F.col("draft"), F.col("unit"))
    length = (F.col("kind") == "length") & F.coalesce("measurable", F.lit(False)) & n.isNotNull()
    missing = F.filter("fields", lambda f: ~field_present(F.col("draft"), f))
    fields = (F.col("kind") == "fields") & (F.coalesce(F.size("fields"), F.lit(0)) > 0)
    broken = (length & (n > F.col("most"))) | (fields & (F.size(missing) > 0))
    outcome = F.when(broken, _level(F.col("published"))).when(~length & ~fields, "declared")
    evidence = F.when(length, F.concat(n.cast("string"), F.lit(" "), F.col("unit"), F.lit(" against "), F.col("most").cast("int").cast("string"))).when(fields, F.array_join(missing, "|")).otherwise(F.coalesce("value", F.lit("")))
    return rows.select("id", F.lit("format_constants").alias("check"), outcome.alias("outcome"), F.col("rule").alias("item"), evidence.alias("evidence")).where("outcome is not null")


def genre_checks(drafts: DataFrame, genres: DataFrame, questions: DataFrame, jargon: DataFrame, constants: DataFrame) -> DataFrame:
    """All outcomes of the three checks."""
    return reader_questions(drafts, genres, questions).unionByName(prohibited_jargon(drafts, genres, jargon)).unionByName(format_constants(drafts, genres, constants))


def anchored(answers: DataFrame, texts: DataFrame, id: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """A model's answers with ``is_anchored``: whether the quote stands in the text but for case and white space (four characters at least)."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return answers.join(texts.select(id, F.col(text).alias("_text")), id).withColumn("is_anchored", (F.length(norm(F.col(quote))) >= 4) & F.contains(norm(F.col("_text")), norm(F.col(quote)))).drop("_text")


def literal_or_concept(pattern: Column, text: Column) -> Column:
    """Whether a plain phrase stands in the text as whole words."""
    return F.contains(padded(text), padded(pattern))
