"""What happens before pairs are made and after they are judged: pages and posts as text, gates with reasons, facets, spans, anonymous ids and counts of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import let, matches, squeezed, strip
from .sequences import html_text

# Patterns and names by which texts are cut and judged.
POST_TAIL = r"(?i)^(?:share this|related (?:posts?|articles?)|leave a reply|tags?:|previous post|next post)"
CONTRACTED_FIRMS = (
    "williams adley", "kpmg", "clifton larson allen", "cliftonlarsonallen", "kearney", "cotton & company", "cotton and company", "rma associates",
    "sikich", "independent public accounting firm", "independent certified public accounting",
)
TECHNICAL_HEADING = r"(?i)\b(Behaviors?|Behaviour|Exploitation|Mechanisms?|Technical details?|Vulnerabilit(y|ies)|How it works|Operation|Details)\b"
TOPIC_SENTENCE = (
    r"(?i)\b(vulnerabilit(y|ies)|exploits?|attacks?|bugs?|flaws?|weakness|malware|worms?|ransomware|trojan|backdoor|rootkit|botnet|spyware|virus|overflow|"
    r"denial.of.service|side.channel|injection|phishing|malicious (software|code|program)|unwanted software|exploitation)\b"
)
EXCLUDED_TITLE = (
    r"(?i)\bdata breach(es)?\b|\bbreach\b|\bhack(ing)?\s+of\b|\bhacked\b|\bcyber ?attack(s)?\b|\battacks? on\b|\bhacking (incident|group)\b|"
    r"\b(19|20)\d{2}\b.{0,40}\b(breach|hack|attack|leak|incident|outage)\b|^Operation\s|\(disambiguation\)|^list of |^category:"
)
NEXT_ITEM, SIGNATURE = r"(?i)\bitem\s*\d{1,2}\.\d{2}\b", r"(?i)\bSIGNATURES?\b"


# --- pages and posts as text ---


def _without(html: Column, tags: str) -> Column:
    return F.regexp_replace(F.regexp_replace(html, rf"(?is)<({tags})\b[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->", " ")


def article_markdown(html: Column, tail: str = POST_TAIL) -> Column:
    """A page's article as lines: of its ``article``, ``main`` and ``body`` elements the one with most text, without
    scripts, navigation and asides; headings with ``#``, other blocks as they are, up to the first line that
    matches ``tail``. Blank if the page has no text."""
    bare = _without(html, "script|style|nav|footer|header|aside|form|noscript")
    parts = F.flatten(F.array(*[matches(bare, rf"(?is)<{t}\b[^>]*>.*?</{t}>") for t in ("article", "main", "body")]))
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(html_text(p)).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
    text = F.coalesce(longest, bare)
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|br|tr|table|section|article|main|body|h[1-6]|blockquote|pre)\b[^>]*>", "\n")
    lines = F.filter(F.transform(F.split(text, "\n"), html_text), lambda x: (x != "") & ~x.rlike("^#+$"))
    return F.array_join(_up_to(lines, tail), "\n")


def _up_to(lines: Column, tail: str) -> Column:
    """The lines before the first that matches."""
    return let(lines, lambda x: let(F.array_position(F.transform(x, lambda s: s.rlike(tail)), True), lambda k: F.when(k > 0, F.slice(x, 1, (k - 1).cast("int"))).otherwise(x)))


def post_paragraphs(html: Column, tail: str = POST_TAIL) -> Column:
    """Paragraphs, items and headings of a post, a line each, up to the first that matches ``tail``."""
    blocks = matches(_without(html, "script|style|nav|footer|header|aside|form"), r"(?is)<(p|li|h2|h3)\b[^>]*>.*?</\1>")
    return F.array_join(_up_to(F.filter(F.transform(blocks, html_text), lambda x: x != ""), tail), "\n")


def clean_head(text: Column) -> Column:
    """Without what stands before the first substantive line: over 120 characters, or over 60 and not ending with a colon or slash."""
    lines = F.split(text, "\n")
    good = lambda s: (F.length(s) > 120) | ((F.length(s) > 60) & ~s.rlike("[:/]$"))
    return strip(let(lines, lambda x: let(F.array_position(F.transform(x, good), True), lambda k: F.when(k > 0, F.array_join(F.slice(x, k.cast("int"), F.size(x)), "\n")).otherwise(text))))


def stripped(text: Column) -> Column:
    """Without comments and headings, white space made single."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?m)^#{1,6}\s*.*$", " "))


def item_passage(text: Column, item: str = r"item\s*1\.05\b") -> Column:
    """From the item's heading to the next item's, or the signatures, or the end; null without the item."""

    def cut(rest: Column) -> Column:
        after = F.substr(rest, F.lit(11))
        ends = F.array_min(F.filter(F.array(*[F.regexp_instr(after, F.lit(p)) for p in (NEXT_ITEM, SIGNATURE)]), lambda x: x > 0))
        return strip(F.when(ends.isNotNull(), F.left(rest, ends + 9)).otherwise(rest))

    at = F.regexp_instr(text, F.lit(f"(?i){item}"))
    return F.when(at > 0, let(F.substr(text, at), cut))


# --- gates, scopes, facets ---


def length_reason(text: Column, least: int | None = None, most: int | None = None) -> Column:
    """``too short``, ``too long`` or null."""
    out = F.lit(None).cast("string")
    if most is not None:
        out = F.when(F.length(text) > most, "too long").otherwise(out)
    return F.when(F.length(text) < least, "too short").otherwise(out) if least is not None else out


def cover_licence(text: Column, heading: str, firms: tuple[str, ...] = CONTRACTED_FIRMS) -> Column:
    """The licence by the cover alone, what stands before the first line that matches ``heading``: a contracted firm there makes it one to be verified."""
    cover = F.lower(F.regexp_extract(text, rf"(?s)^(.*?)(?:(?=(?m:{heading}))|\z)", 1))
    named = F.lit(False)
    for firm in firms:
        named = named | cover.contains(firm)
    return F.when(named, "us-gov-contracted-verify").otherwise("public-domain-us-gov")


def scope_reasons(title: Column, lead: Column, headings: Column) -> Column:
    """Why an article is out of scope, joined by ``; ``, blank if it is in: its title, no technical heading, a lead of one paragraph, a first sentence that names no vulnerability, exploit or malware."""
    first = F.get(F.split(lead, "\n"), F.lit(0))
    sentence = F.coalesce(F.nullif(F.regexp_extract(F.concat(first, F.lit(" ")), r"^(.{40,400}?[.!?])\s", 1), F.lit("")), F.left(first, F.lit(400)))
    paragraphs = F.size(F.filter(F.split(lead, r"\n+"), lambda p: F.trim(p) != ""))
    return F.concat_ws(
        "; ", F.when(title.rlike(EXCLUDED_TITLE), "title out of scope"), F.when(~F.exists(headings, lambda h: h.rlike(TECHNICAL_HEADING)), "no technical heading"),
        F.when(paragraphs < 2, "lead of one paragraph"), F.when(~sentence.rlike(TOPIC_SENTENCE), "first sentence names no topic"),
    )


def by_facets(rows: DataFrame, facets: dict[str, list[str]], query: str = "", searched: tuple[str, ...] = ()) -> DataFrame:
    """Rows that have one of the values of each facet, blank being ``(none)``, and the query in one of the searched columns, whatever its case."""
    for name, values in facets.items():
        if values:
            rows = rows.where(F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("(none)")).isin(*values))
    if query:
        found = F.lit(False)
        for name in searched:
            found = found | F.coalesce(F.lower(F.col(name).cast("string")).contains(query.lower()), F.lit(False))
        rows = rows.where(found)
    return rows


# --- joins and sets ---


def posts_with_reports(mapping: DataFrame, posts: DataFrame, reports: DataFrame, least: int = 400) -> DataFrame:
    """(``slug``, ``report``, ``executive_text``, ``technical_text``): each post of at least ``least`` characters with every report that ``mapping(slug, reports)`` names and that is there."""
    named = mapping.select("slug", F.explode("reports").alias("report")).distinct()
    cleaned = posts.select("slug", clean_head(F.col("text")).alias("executive_text")).where(F.length("executive_text") >= least)
    return named.join(cleaned, "slug").join(reports.select("report", F.col("text").alias("technical_text")), "report")


def by_position(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Rows of two tables with the same stored position. The order of rows itself is never relied on."""
    return a.join(b, position)


def lost_ids(before: DataFrame, after: DataFrame, id: str) -> DataFrame:
    """The ids that were there before and are no more."""
    return before.select(id).distinct().join(after.select(id), id, "left_anti")


def with_filled_blanks(rows: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with blank values of the columns filled from ``known``, one row per key; what is there stays. To be written to a new path, which then takes the old one's place."""
    filled = known.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    value = lambda c: F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.col(f"_new_{c}"), F.col(c))
    out = rows.join(filled, F.col(key) == F.col("_key"), "left")
    return out.select(*[value(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


# --- spans and terms ---


def merged_spans(text: Column, spans: Column) -> Column:
    """The literal slices at ``spans(start, stop)`` (from 0): those with only white space between are one slice, the rest are joined by a space."""
    empty = F.expr("cast(array() as array<struct<start:int,stop:int>>)")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = F.trim(F.substr(text, last["stop"] + 1, F.greatest(x["start"] - last["stop"], F.lit(0))), F.lit(" \t\r\n")) == ""
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        own = F.struct(x["start"].cast("int").alias("start"), x["stop"].cast("int").alias("stop"))
        return F.when((F.size(done) > 0) & near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(own)))

    whole = F.aggregate(F.array_sort(F.array_distinct(spans)), empty, add)
    return F.array_join(F.transform(whole, lambda s: F.substr(text, s["start"] + 1, s["stop"] - s["start"])), " ")


def concept_label(concept: Column, limit: int = 46) -> Column:
    """The concept up to a bracket, slash, `` explained ``, `` via `` or semicolon; cut two short of ``limit`` with an ellipsis."""
    label = F.trim(F.regexp_replace(F.trim(F.get(F.split(concept, r"\(| / | explained | via |;"), F.lit(0))), "/+$", ""))
    return F.when(F.length(label) > limit, F.concat(F.left(label, F.lit(limit - 2)), F.lit("…"))).otherwise(label)


def match_terms(concept: Column, aliases: dict[str, tuple[str, ...]], generic: tuple[str, ...]) -> Column:
    """Aliases of the patterns that the concept matches, then its words of three letters or more that are not generic; each once."""
    named = [F.when(concept.rlike(f"(?i){p}"), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for p, terms in aliases.items()]
    words = F.filter(matches(F.lower(concept), "[a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*generic))
    return F.array_distinct(F.concat(*named, words))


# --- evaluation ---


def anonymised(items: DataFrame, key: str, seed: int = 20260718, prefix: str = "IT") -> DataFrame:
    """``items`` with ``item_id``: numbers in an order by hash of seed and key, so the same in every run. A sheet for readers takes it and drops what names the model; the mapping is kept apart. Small tables only: one order over all."""
    order = W.partitionBy(F.lit(1)).orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return items.withColumn("item_id", F.format_string(f"{prefix}%03d", F.row_number().over(order)))


def arm_counts(items: DataFrame, arm: str, finding: str, text: str, ok: str) -> DataFrame:
    """Per arm with at most two findings missing: ``n``, ``n_failed`` and ``n_empty``."""
    total = items.agg(F.countDistinct(finding).alias("_all"))
    out = items.groupBy(arm).agg(F.count("*").alias("n"), F.count_if(~F.col(ok)).alias("n_failed"), F.count_if(F.coalesce(F.trim(F.col(text)), F.lit("")) == "").alias("n_empty"))
    return out.join(F.broadcast(total), F.col("n") >= F.col("_all") - 2).drop("_all")


def citing_sentences(pairs: DataFrame, text: str, pattern: str) -> DataFrame:
    """Of the distinct texts that cite an identifier: how many cite one, how many more, and the latter's share."""
    n = F.size(F.array_distinct(matches(F.col(text), pattern)))
    return pairs.select(text).distinct().select(n.alias("k")).agg(F.count_if(F.col("k") == 1).alias("single"), F.count_if(F.col("k") > 1).alias("multiple")).withColumn("share", F.round(F.col("multiple") / F.greatest(F.col("single") + F.col("multiple"), F.lit(1)), 6))


def evidence_metrics(pairs: DataFrame, source: str, draft: str, band: str) -> DataFrame:
    """Per band: pairs, shares of drafts that keep an identifier, a number or a severity word of a source that has one, that hedge, that are one sentence, and the median words of draft and source."""
    from ..functions.text import identifiers, numbers, sentences, severity, word_count
    from .checks import HEDGE

    s, d = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(draft), F.lit(""))
    facts = pairs.select(
        F.col(band).alias("band"), identifiers(s).alias("si"), identifiers(d).alias("di"), numbers(s).alias("sn"), numbers(d).alias("dn"), severity(s).isNotNull().alias("ss"), severity(d).isNotNull().alias("ds"),
        d.rlike(HEDGE).alias("hedged"), (F.size(sentences(d)) == 1).alias("single"), word_count(s).alias("sw"), word_count(d).alias("dw"),
    )
    share = lambda has, kept: F.round(F.avg(F.when(has, kept.cast("int"))), 6)
    return facts.groupBy("band").agg(
        F.count("*").alias("n"), share(F.size("si") > 0, F.arrays_overlap("si", "di")).alias("keeps_id"), share(F.size("sn") > 0, F.arrays_overlap("sn", "dn")).alias("keeps_number"), share(F.col("ss"), F.col("ds")).alias("keeps_severity"),
        share(F.lit(True), F.col("hedged")).alias("hedged"), share(F.lit(True), F.col("single")).alias("one_sentence"), F.round(F.percentile("dw", F.lit(0.5)), 6).alias("median_draft_words"), F.round(F.percentile("sw", F.lit(0.5)), 6).alias("median_source_words"),
    )


def markdown_rows(rows: DataFrame, columns: list[str]) -> Column:
    """A row as a line of a markdown table, null as blank, ``|`` and line breaks made harmless."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
