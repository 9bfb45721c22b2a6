"""Operators over ordered lines, numbers and markup: sections, nearest anchors, ranges, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import let, squeezed


def with_sections(rows: DataFrame, doc: str, order: str, is_heading: Column, title: Column) -> DataFrame:
    """``rows`` with ``section`` (0 before the first heading) and ``heading``: each line belongs to the last heading."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("section", F.sum(is_heading.cast("int")).over(w)).withColumn("heading", F.last(F.when(is_heading, title), True).over(w))


def section_end(rows: DataFrame, doc: str, order: str, level: Column) -> DataFrame:
    """Headings with ``end``: where the next heading of the same or a higher level begins, null at the end.

    For each level the next heading of at most that level is carried back over the document.
    """
    after = W.partitionBy(doc).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    out = rows.withColumn("_level", level)
    ends = [F.when(F.col("_level") == n, F.min(F.when(F.col("_level") <= n, F.col(order))).over(after)) for n in range(1, 7)]
    return out.withColumn("end", F.coalesce(*ends)).drop("_level")


def segments(starts: DataFrame, doc: str, order: str, length: Column) -> DataFrame:
    """Starts with ``stop``: the next start of the document, or its length."""
    return starts.withColumn("stop", F.lead(order).over(W.partitionBy(doc).orderBy(order))).withColumn("stop", F.coalesce("stop", length))


def increasing(rows: DataFrame, doc: str, order: str, number: str) -> DataFrame:
    """Rows whose number is greater than all before it in the document."""
    before = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max(number).over(before)).where(F.col("_m").isNull() | (F.col(number) > F.col("_m"))).drop("_m")


def nearest_lower(rows: DataFrame, group: str, at: Column, is_anchor: Column, id: str, most: int) -> DataFrame:
    """``rows`` with ``host``, the id of the last anchor at or before them in the group, and the ``gap``, where that is at most ``most``."""
    w = W.partitionBy(group).orderBy("_at", id).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("_at", at).withColumn("_h", F.last(F.when(is_anchor, F.struct(F.col(id).alias("id"), F.col("_at").alias("at"))), True).over(w))
    gap = F.col("_at") - F.col("_h.at")
    return out.withColumn("host", F.when(gap <= most, F.col("_h.id"))).withColumn("gap", F.when(gap <= most, gap)).drop("_at", "_h")


def range_join(citing: DataFrame, targets: DataFrame, span: int = 20) -> DataFrame:
    """(``doc``, ``citing``, ``cited``): the numbers that the ranges of ``citing(doc, citing, ranges)`` name, backward only, not itself, no range longer than ``span``, and that ``targets(doc, num)`` has."""
    ranges = citing.select("doc", "citing", F.explode("ranges").alias("r")).where((F.col("r.b") >= F.col("r.a")) & (F.col("r.b") - F.col("r.a") <= span))
    named = ranges.select("doc", "citing", F.explode(F.sequence("r.a", "r.b")).alias("num")).where("num < citing").distinct()
    found = named.join(targets.select("doc", "num").distinct(), ["doc", "num"])
    return found.groupBy("doc", "citing").agg(F.array_join(F.array_sort(F.collect_list("num")).cast("array<string>"), ",").alias("cited"))


def paragraph_ranges(text: Column) -> Column:
    """The ranges of a phrase such as ``paragraphs 13 to 29, 31 and 40-42``, as an array of structs."""
    tail = F.regexp_extract(text, r"(?i)paragraphs?\s+((?:\d+(?:\s*(?:to|through|-|–)\s*\d+)?(?:\s*(?:,|and)\s*)*)+)", 1)
    parts = F.regexp_extract_all(tail, F.lit(r"\d+(?:\s*(?:to|through|-|–)\s*\d+)?"), F.lit(0))
    return F.transform(parts, lambda p: let(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), lambda n: F.struct(F.get(n, F.lit(0)).cast("int").alias("a"), F.element_at(n, -1).cast("int").alias("b"))))


def markdown_headings(text: Column) -> Column:
    """(``line``, ``level``, ``title``) of the ``#`` headings of a text."""
    found = F.transform(F.split(text, "\n"), lambda s, i: F.when(s.rlike(r"^#{1,6}\s+\S"), F.struct(i.alias("line"), F.length(F.regexp_extract(s, "^(#+)", 1)).alias("level"), squeezed(F.regexp_replace(s, r"^#+\s+", "")).alias("title"))))
    return F.filter(found, lambda x: x.isNotNull())


def numbered_table(text: Column) -> Column:
    """Rows of a markdown table that begin with a number, as ``struct<number, title, severity>``; the severity is the first severity word of the next three cells."""

    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), squeezed)
        severity = F.filter(F.slice(cells, 2, 4), lambda c: c.rlike(r"(?i)^(?:critical|high|medium|low|informational|undetermined)$"))
        return F.struct(F.regexp_extract(F.get(cells, F.lit(0)), r"^(\d+)", 1).cast("int").alias("number"), F.get(cells, F.lit(1)).alias("title"), F.coalesce(F.get(severity, F.lit(0)), F.lit("")).alias("severity"))

    return F.transform(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*\|\s*\d+\s*\|")), row)


# --- markup ---


def html_headings(html: Column) -> Column:
    """(``level``, ``title``) of h1 to h6 in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0)), lambda h: F.struct(F.substr(h, F.lit(3), F.lit(1)).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " ")).alias("title")))


def html_title(html: Column) -> Column:
    """The first h1, else the title."""
    inner = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags out, common entities decoded, white space made single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_sections(html: Column) -> Column:
    """(``heading``, ``body``) of each h2 or h3 up to the next, without script, style, navigation, header and footer."""
    main = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)[^>]*>.*?</\1>", " ")
    parts = F.slice(F.split(main, r"(?i)<h[23][^>]*>"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(html_text(F.regexp_extract(p, r"(?is)^(.*?)</h[23]>", 1)).alias("heading"), html_text(F.regexp_replace(p, r"(?is)^.*?</h[23]>", "")).alias("body")))
