"""Validation of parsed documents: named tests, warnings and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, matches

# Limits of the tests.
CHARS_PER_PAGE = (400, 8000)
DICTIONARY_FAIL, DICTIONARY_WARN = 0.55, 0.68
MOJIBAKE_MOST, EMPTY_CELLS_MOST, DEGENERATE_MOST = 0.001, 0.6, 0.5
HEADINGS = {"generic": (r"(?im)^#{1,4}\s.*(?:executive|summary|overview)", r"(?im)^#{1,4}\s.*(?:findings|vulnerabilit|issues|results)", False)}


def dictionary_ratio(docs: DataFrame, words: DataFrame, id: str, text: str) -> DataFrame:
    """(id, ``ratio``): the share of words of two letters or more that ``words(word)`` has. Words are counted per document before they are joined."""
    plain = F.regexp_replace(F.col(text), r"[#|*`\-]", " ")
    tokens = docs.select(id, F.explode(matches(F.lower(plain), "[a-z]{2,}")).alias("word")).groupBy(id, "word").agg(F.count("*").alias("n"))
    known = words.select("word").distinct().withColumn("known", F.lit(1))
    return tokens.join(known, "word", "left").groupBy(id).agg((F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / F.sum("n")).alias("ratio"))


def validate(docs: DataFrame, words: DataFrame, id: str = "doc", text: str = "md", pages: str = "n_pages", tables: str = "table_stats", firm: str = "generic") -> DataFrame:
    """(id, ``checks`` map, ``warns`` array, ``chars_per_page``, ``dict_ratio``, ``mojibake``, ``passed``) per document."""
    summary, findings, expects_tables = HEADINGS.get(firm, HEADINGS["generic"])
    rows = docs.join(dictionary_ratio(docs, words, id, text), id, "left")
    md = F.col(text)
    per_page = F.length(F.regexp_replace(md, r"[#|*`\-]", " ")) / F.greatest(F.col(pages), F.lit(1))
    broken = (F.regexp_count(md, F.lit(r"\x{FFFD}|\(cid:\d+\)"))) / F.greatest(F.length(md), F.lit(1))
    ratio = F.coalesce("ratio", F.lit(0.0))
    data = F.filter(F.col(tables), lambda t: t["num_rows"] >= 2)
    poor = F.filter(data, lambda t: (t["num_cols"] < 2) | (t["empty_cell_frac"] >= EMPTY_CELLS_MOST))
    fine = (F.size(data) == 0) | (F.size(poor) / F.greatest(F.size(data), F.lit(1)) <= DEGENERATE_MOST)
    if expects_tables:
        fine = fine & (F.size(F.col(tables)) > 0)
    tests = {
        "chars_per_page_ok": per_page.between(*CHARS_PER_PAGE), "dict_ratio_ok": ratio >= DICTIONARY_FAIL, "mojibake_ok": broken < MOJIBAKE_MOST,
        "exec_section_ok": md.rlike(summary), "findings_section_ok": md.rlike(findings), "tables_ok": fine, "severity_ok": md.rlike(r"(?i)\b(critical|high|medium|low|informational)\b"),
    }
    warns = F.filter(F.array(F.when((ratio >= DICTIONARY_FAIL) & (ratio < DICTIONARY_WARN), F.lit("few dictionary words")), F.when(F.size(poor) > 0, F.lit("degenerate tables"))), lambda w: w.isNotNull())
    checks = F.create_map(*[x for name, test in tests.items() for x in (F.lit(name), test)])
    return rows.select(id, checks.alias("checks"), warns.alias("warns"), F.round(per_page, 3).alias("chars_per_page"), F.round(ratio, 6).alias("dict_ratio"), F.round(broken, 6).alias("mojibake"), let(checks, lambda m: F.forall(F.map_values(m), lambda x: x)).alias("passed"))


def canonical_halves(pair: Column, snapshot: Column) -> Column:
    """Whether a text stands in a snapshot once quotes, dashes and white space are made plain in both."""
    from ..functions.text import canonical

    return F.contains(canonical(snapshot), canonical(pair))
