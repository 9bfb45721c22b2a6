"""Scores of paragraphs and phrases: densities of keywords, dominance of markers, parsed limits, and weak name matches for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import compact, let


def keyword_density(text: Column, pattern: str, heading: Column | None = None, nudge: float = 2.5, unit: int = 500) -> Column:
    """Matches per ``unit`` characters (at least one unit), plus ``nudge`` if the heading matches too."""
    score = F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text) / F.lit(unit), F.lit(1.0))
    return score if heading is None else score + F.when(heading.rlike(pattern), F.lit(nudge)).otherwise(F.lit(0.0))


def bucketed(sections: DataFrame, doc: str, technical: Column, executive: Column, least: float = 1.0) -> DataFrame:
    """``sections`` with ``bucket``: technical or executive by the greater score from ``least`` on, else none; a document without any of a kind has its best section promoted to it."""
    rows = sections.withColumns({"_t": technical, "_e": executive})
    bucket = F.when((F.col("_t") >= least) & (F.col("_t") >= F.col("_e")), "technical").when(F.col("_e") >= least, "executive")
    rows, by = rows.withColumn("bucket", bucket), W.partitionBy(doc)
    lacks = lambda kind: ~F.coalesce(F.bool_or(F.col("bucket") == kind).over(by), F.lit(False))
    best = lambda c: (F.col(c) > 0) & (F.col(c) == F.max(F.when(F.col("bucket").isNull(), F.col(c))).over(by)) & F.col("bucket").isNull()
    promoted = F.when(lacks("technical") & best("_t"), "technical").when(lacks("executive") & best("_e"), "executive")
    return rows.withColumn("bucket", F.coalesce("bucket", promoted)).drop("_t", "_e")


def dominance(text: Column, technical: str, legal: str, ratio: float = 2.0) -> Column:
    """``technical``, ``legal`` or ``mixed``: which markers are at least ``ratio`` times the others; null without any, and for a null text."""
    t, g = F.regexp_count(text, F.lit(technical)), F.regexp_count(text, F.lit(legal))
    return F.when(F.coalesce(t + g, F.lit(0)) == 0, F.lit(None)).when(t >= g * ratio, "technical").when(g >= t * ratio, "legal").otherwise("mixed")


def parsed_limit(text: Column) -> Column:
    """``struct<unit, most, measurable>`` of a phrase such as ``120 to 180 words``; words and sentences can be measured in text."""
    rx = r"(?i)(?:(\d+)\s*(?:to|-|–)\s*)?(\d+)\s*(words?|sentences?|pages?|slides?|minutes?|hours?|days?)"
    unit = F.concat(F.regexp_replace(F.lower(F.regexp_extract(text, rx, 3)), "s$", ""), F.lit("s"))
    most = F.greatest(F.regexp_extract(text, rx, 2).try_cast("double"), F.regexp_extract(text, rx, 1).try_cast("double"))
    return F.when(text.rlike(rx), F.struct(unit.alias("unit"), most.alias("most"), unit.isin("words", "sentences").alias("measurable")))


def weak_name_matches(names: DataFrame, keys: DataFrame, least: int = 12, gram: int = 8) -> DataFrame:
    """(``name``, ``key``) where one contains the other, letters and digits only, the shorter of ``least`` characters: for a report, never to fill anything.

    Names that contain each other share every run of ``gram`` characters of the shorter one, so its first run is
    looked up among all runs of the longer one; no cross join is made.
    """

    def runs(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        base = rows.select(F.col(column)).distinct().withColumn("c", compact(F.col(column))).where(F.length("c") >= least)
        all_runs = base.select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c") - gram + 1), lambda i: F.substr("c", i, F.lit(gram))))).alias("g"))
        return base.withColumn("g", F.left("c", F.lit(gram))), all_runs

    (n1, n_all), (k1, k_all) = runs(names, "name"), runs(keys, "key")
    inside = n1.withColumnRenamed("c", "cn").join(k_all.withColumnRenamed("c", "ck"), "g").where(F.contains("ck", F.col("cn")))
    around = n_all.withColumnRenamed("c", "cn").join(k1.withColumnRenamed("c", "ck"), "g").where(F.contains("cn", F.col("ck")))
    return inside.select("name", "key").unionByName(around.select("name", "key")).distinct()


def section_stats(text: Column, identifiers: str = r"CVE-\d{4}-\d{4,7}") -> Column:
    """``struct<n_headings, n_words, n_ids, ids_per_1000_words>`` of a document."""
    n = F.regexp_count(text, F.lit(r"\S+"))
    ids = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(identifiers), F.lit(0))))
    return let(F.struct(F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s+\S")).alias("h"), n.alias("n"), ids.alias("i")), lambda s: F.struct(s["h"].alias("n_headings"), s["n"].alias("n_words"), s["i"].alias("n_ids"), F.round(s["i"] * 1000 / F.greatest(s["n"], F.lit(1)), 3).alias("ids_per_1000_words")))
