"""Pairs out of documents: findings are segmented, and executive sentences joined to those that they name, cite or resemble.

Everything works on the lines of all documents at once: sections and segments are windows over a document's lines,
and pairs are joins on (document, number). Texts of pairs are literal slices of their sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import compact, let, matches, prose_sentences, severity, significant_words, sorted_set, squeezed, strip
from .checks import CAVEAT_MARKERS
from .sequences import increasing, segments

# Headings, identifiers and openers by which reports are read.
HEADING = r"^#{1,6}\s*(.+?)\s*$"
FINDINGS_BEGIN, FINDINGS_END = r"(?i)^Detailed Findings$", r"(?i)^(Summary of (Fix|Code)|Appendi|About Trail)"
SUMMARY_BEGIN = r"(?i)^Executive Summary$"
SUMMARY_END = r"(?i)Finding Severities|Project Goals|Summary of Findings|System Architecture|Methodology"
CONCLUSION_BEGIN = r"(?i)^Conclusions?$"
ID_FINDING = r"^#{1,6}\s*([A-Z]{2,4}-\d{2}-\d{3})\s+(.+?)\s*\(\s*(\w+)\s*\)\s*$"
ID_FINDING_STOP = r"(?i)^#{1,6}\s.*(Conclusions?|Miscellaneous Issues|Identified Vulnerabilities)"
ID_CITED, NUMBER_CITED = r"\b([A-Z]{2,4}-\d{2}-\d{3})\b", r"TOB-[A-Z0-9]+-(\d+)"
NUMBERED_LINE, NUMBERED_CELL = r"^(?:#{1,6}\s*)?(\d{1,2})\.\s+(\S.*?)\s*$", r"^\|\s*(\d{1,2})\.\s+([^|]+?)\s*\|"
PROPERTY_BOX = r"Finding ID:\s*TOB-[A-Z0-9]+-(\d{1,2})\b"
ANAPHORA = r"(?i)^(This|These|That|Those|Such|It|They|Both)\b"
SEVERITY_WORDS = ("critical", "high", "medium", "low", "informational", "info", "undetermined")
MOST_CHARS = 6000


def doc_lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(``doc``, ``n``, ``t``): every line with its number."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("n", "t"))


def between(lines: DataFrame, begin: str, end: str | None) -> DataFrame:
    """Each document's lines after the first heading that matches ``begin``, up to the next one that matches ``end``."""
    title = F.when(F.col("t").rlike(HEADING), F.regexp_extract("t", HEADING, 1))
    by = W.partitionBy("doc")
    first = F.min(F.when(title.rlike(begin), F.col("n"))).over(by)
    out = lines.withColumn("_title", title).withColumn("_first", first).where("n > _first")
    last = F.min(F.when(F.col("_title").rlike(end), F.col("n"))).over(by) if end else F.lit(None).cast("int")
    return out.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("n") < F.col("_last"))).drop("_title", "_first", "_last")


def _body(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts(doc, n, stop, ...)`` with ``text``: the lines after the start, before the stop."""
    inside = starts.join(lines.select(F.col("doc").alias("_d"), F.col("n").alias("_n"), "t"), (F.col("doc") == F.col("_d")) & (F.col("_n") > F.col("n")) & (F.col("_n") < F.col("stop")), "left")
    keep = [c for c in starts.columns]
    return inside.groupBy(*keep).agg(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("_n", "t")))).alias("_x")).withColumn("text", strip(F.array_join(F.transform("_x", lambda x: x["t"]), "\n"))).drop("_x")


# --- numbered findings ---


def finding_table(lines: DataFrame) -> DataFrame:
    """(``doc``, ``number``, ``title``, ``severity``) of table rows that begin with a number and a title of eight characters; the first row counts, its severity filled from later ones."""
    cells = F.transform(F.split(F.regexp_replace("t", r"^\|\s*\d{1,2}\s*\||\|\s*$", ""), r"\|"), strip)
    rows = lines.where(F.col("t").rlike(r"^\|\s*\d{1,2}\s*\|.+\|\s*$")).select("doc", "n", F.regexp_extract("t", r"^\|\s*(\d{1,2})", 1).cast("int").alias("number"), cells.alias("c"))
    found = F.get(F.filter(F.slice("c", 2, 3), lambda x: F.lower(x).isin(*SEVERITY_WORDS)), F.lit(0))
    rows = rows.withColumns({"title": F.get("c", F.lit(0)), "sev": found}).where(F.length("title") >= 8)
    return rows.groupBy("doc", "number").agg(F.min_by("title", "n").alias("title"), F.coalesce(F.min_by("sev", F.when(F.col("sev").isNotNull(), F.col("n"))), F.lit("")).alias("severity"))


def _same_title(a: Column, b: Column) -> Column:
    x, y = F.left(compact(a), F.lit(24)), F.left(compact(b), F.lit(24))
    return (x != "") & (y != "") & ((F.left(x, F.lit(12)) == F.left(y, F.lit(12))) | F.contains(x, y) | F.contains(y, x))


def numbered_findings(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(``doc``, ``number``, ``title``, ``severity``, ``text``): the detailed findings, cut where a line names a number of the summary table.

    A cut is a heading, or a line or table header whose title is like the table's, with numbers rising through
    the document. Numbers missed that way are recovered from property boxes. What stands before the first cut is
    finding 1, if that is missing and long enough.
    """
    lines = doc_lines(docs, doc, text)
    table = finding_table(lines)
    body = between(lines, FINDINGS_BEGIN, FINDINGS_END)
    t = strip(F.col("t"))
    number = F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p in (NUMBERED_LINE, NUMBERED_CELL)]).cast("int")
    title = F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 2)) for p in (NUMBERED_LINE, NUMBERED_CELL)])
    named = body.select("doc", "n", number.alias("number"), title.alias("inline"), t.startswith("#").alias("heading")).where("number is not null").join(table, ["doc", "number"])
    cuts = increasing(named.where(F.col("heading") | _same_title(F.col("inline"), F.col("title"))), "doc", "n", "number").select("doc", "n", "number", F.col("inline").alias("title"), "severity")
    box = F.regexp_extract("t", PROPERTY_BOX, 1).try_cast("int")
    before = lambda k: F.lag("t", k).over(W.partitionBy("doc").orderBy("n"))
    boxes = body.withColumns({"number": box, "b1": before(1), "b2": before(2)}).where("number is not null").join(table, ["doc", "number"]).join(cuts.select("doc", "number"), ["doc", "number"], "left_anti")
    trimmed = lambda c: F.regexp_replace(F.col(c), r"^[|# ]+|[|# ]+$", "")
    start = F.when(_same_title(trimmed("b1"), F.col("title")), F.col("n") - 1).when(_same_title(trimmed("b2"), F.col("title")), F.col("n") - 2).otherwise(F.col("n"))
    boxes = boxes.groupBy("doc", "number").agg(F.min_by(F.struct(start.alias("n"), "title", "severity"), "n").alias("x")).select("doc", "x.n", "number", "x.title", "x.severity")
    ends = body.groupBy("doc").agg(F.min("n").alias("first"), (F.max("n") + 1).alias("end"))
    starts = segments(cuts.unionByName(boxes).join(ends, "doc"), "doc", "n", F.col("end"))
    units = _body(body, starts.select("doc", "n", "stop", "number", "title", "severity"))
    head = starts.groupBy("doc").agg(F.min_by(F.struct("n", "number", "first"), "n").alias("h")).where("h.number >= 2 and h.n - h.first > 3")
    one = head.join(table.where("number = 1"), "doc").select("doc", (F.col("h.first") - 1).alias("n"), F.col("h.n").alias("stop"), "number", "title", "severity")
    return units.unionByName(_body(body, one).where(F.length("text") > 200)).select("doc", "number", "title", "severity", "text")


def summary_sentences(docs: DataFrame, begin: str = SUMMARY_BEGIN, end: str = SUMMARY_END, doc: str = "doc", text: str = "text") -> DataFrame:
    """(``doc``, ``para``, ``s``, ``sentence``) of the summary section; headings, comments and blank lines end a paragraph."""
    section = between(doc_lines(docs, doc, text), begin, end).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("x", lambda x: x["t"]), "\n"), r"(?s)<!--.*?-->", "\n\n"), r"(?m)^#{1,6}.*$", "\n")
    paras = section.select("doc", F.posexplode(F.split(whole, r"\n\s*\n")).alias("para", "p"))
    return paras.select("doc", "para", F.posexplode(prose_sentences(F.col("p"))).alias("s", "sentence"))


def with_antecedents(sentences: DataFrame) -> DataFrame:
    """A sentence that opens with a pronoun is preceded by the one before it in its paragraph, and that by its own, two at most."""
    order = W.partitionBy("doc", "para").orderBy("s")
    rows = sentences.withColumns({"p1": F.lag("sentence", 1).over(order), "p2": F.lag("sentence", 2).over(order)})
    join = lambda a, b: F.concat(a, F.when(a.rlike(r"[.!?:]\s*$"), " ").otherwise(". "), b)
    one = F.col("sentence").rlike(ANAPHORA) & F.col("p1").isNotNull()
    two = one & F.col("p1").rlike(ANAPHORA) & F.col("p2").isNotNull()
    return rows.withColumn("span", F.when(two, join(join(F.col("p2"), F.col("p1")), F.col("sentence"))).when(one, join(F.col("p1"), F.col("sentence"))).otherwise(F.col("sentence"))).drop("p1", "p2")


def numbered_candidates(docs: DataFrame, findings: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Summary sentences joined to the findings of their document that they name by number; 1:1 or 1:N by how many they name."""
    rows = with_antecedents(summary_sentences(docs, doc=doc, text=text)).withColumn("nums", sorted_set(F.transform(matches(F.col("sentence"), NUMBER_CITED, 1), lambda x: x.cast("int")))).where(F.size("nums") > 0)
    named = rows.select("doc", "para", "s", "span", F.size("nums").alias("k"), F.explode("nums").alias("number"))
    body = F.left(F.concat("title", F.lit("\n\n"), "text"), F.lit(MOST_CHARS))
    return named.join(findings, ["doc", "number"]).select(
        F.concat("doc", F.lit("#s"), F.col("para").cast("string"), F.lit("."), F.col("s").cast("string"), F.lit("-f"), F.col("number").cast("string")).alias("pair_id"), F.col("doc").alias("source_doc_id"), body.alias("technical_text"),
        F.col("title").alias("technical_context"), F.col("span").alias("executive_text"), F.lit("id_anchor").alias("alignment_method"), F.when(F.col("k") == 1, "1:1").otherwise("1:N").alias("alignment_type"),
        F.array(F.concat(F.lit("#"), F.col("number").cast("string"))).alias("cited_ids"), F.array("number").alias("finding_numbers"), F.col("severity").alias("severity_original"),
    )


# --- findings with string ids ---


def id_findings(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(``doc``, ``fid``, ``title``, ``severity``, ``text``) of headings such as ``### ABC-01-002 Title (High)``."""
    lines = doc_lines(docs, doc, text)
    head, stop = F.col("t").rlike(ID_FINDING), F.col("t").rlike(ID_FINDING_STOP)
    ends = lines.groupBy("doc").agg((F.max("n") + 1).alias("end"))
    marks = segments(lines.where(head | stop).join(ends, "doc"), "doc", "n", F.col("end")).where(F.col("t").rlike(ID_FINDING))
    part = lambda k: F.regexp_extract("t", ID_FINDING, k)
    return _body(lines, marks.select("doc", "n", "stop", part(1).alias("fid"), part(2).alias("title"), part(3).alias("severity"))).select("doc", "fid", "title", "severity", "text")


def id_candidates(docs: DataFrame, findings: DataFrame, begin: str = CONCLUSION_BEGIN, register: str = "technical_leadership", doc: str = "doc", text: str = "text") -> DataFrame:
    """Sentences of the conclusions, or whole bullets, joined to the findings whose ids they name."""
    lines = between(doc_lines(docs, doc, text), begin, None).withColumn("t", strip(F.col("t")))
    bullet = F.col("t").rlike("^[-·]")
    chunks = lines.select("doc", "n", bullet.alias("bullet"), F.posexplode(F.when(bullet, F.array("t")).otherwise(prose_sentences(F.col("t")))).alias("c", "chunk"))
    rows = chunks.withColumn("ids", sorted_set(matches(F.col("chunk"), ID_CITED, 1))).where(F.size("ids") > 0)
    named = rows.select("*", F.explode("ids").alias("fid")).join(findings, ["doc", "fid"])
    name = F.concat("fid", F.lit(" "), "title")
    return named.select(
        F.concat("doc", F.lit("#"), F.col("n").cast("string"), F.lit("."), F.col("c").cast("string"), F.lit("-"), "fid").alias("pair_id"), F.col("doc").alias("source_doc_id"), F.left(F.concat(name, F.lit("\n\n"), "text"), F.lit(MOST_CHARS)).alias("technical_text"),
        name.alias("technical_context"), F.col("chunk").alias("executive_text"), F.lit(register).alias("audience_observed"), F.lit("id_anchor").alias("alignment_method"), F.when(F.size("ids") == 1, "1:1").otherwise("1:N").alias("alignment_type"),
        F.col("ids").alias("cited_ids"), F.col("severity").alias("severity_original"), F.when(F.col("bullet"), "bullet_list").otherwise("prose").alias("exec_span_kind"),
    )


# --- sections, claims, paragraphs ---


def section_pairs(docs: DataFrame, summary: str, technical: str, least: int = 200, doc: str = "doc", text: str = "text") -> DataFrame:
    """(``doc``, ``executive_text``, ``technical_text``): a document's section under one heading with that under another, each of at least ``least`` characters."""
    lines = doc_lines(docs, doc, text)

    def part(begin: str, name: str) -> DataFrame:
        rows = between(lines, begin, r".").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
        return rows.select("doc", strip(F.array_join(F.transform("x", lambda x: x["t"]), "\n")).alias(name)).where(F.length(name) >= least)

    return part(summary, "executive_text").join(part(technical, "technical_text"), "doc")


def best_match(claims: DataFrame, targets: DataFrame, least: int = 3) -> DataFrame:
    """(``doc``, ``claim``, ``target``, ``score``): of ``claims(doc, claim, text)`` and ``targets(doc, target, text)`` in one document the target with most significant words in common, the first on a tie, none below ``least``.

    Words are exploded and joined within a document, so no pair without a word in common is made.
    """
    words = lambda rows, id: rows.select("doc", id, F.explode(significant_words(F.col("text"))).alias("w"))
    scores = words(claims, "claim").join(words(targets, "target"), ["doc", "w"]).groupBy("doc", "claim", "target").agg(F.count("*").alias("score")).where(F.col("score") >= least)
    return scores.withColumn("_r", F.row_number().over(W.partitionBy("doc", "claim").orderBy(F.desc("score"), "target"))).where("_r = 1").drop("_r")


def cited_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Of ``paragraphs(doc, num, section, text)``: each that cites others, with the text of the cited ones joined in order, and their numbers."""
    from .sequences import paragraph_ranges, range_join

    citing = paragraphs.select("doc", F.col("num").alias("citing"), paragraph_ranges(F.col("text")).alias("ranges")).where(F.size("ranges") > 0)
    found = range_join(citing, paragraphs).select("doc", "citing", F.explode(F.split("cited", ",").cast("array<int>")).alias("num"))
    grouped = found.join(paragraphs.select("doc", "num", "text"), ["doc", "num"]).groupBy("doc", "citing").agg(F.array_sort(F.collect_list(F.struct("num", "text"))).alias("x"))
    return grouped.join(paragraphs.select("doc", F.col("num").alias("citing"), F.col("text").alias("executive_text")), ["doc", "citing"]).select("doc", "citing", F.transform("x", lambda x: x["num"]).alias("cited"), F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("technical_text"), "executive_text")


def same_section(paragraphs: DataFrame, legal: Column, cited: DataFrame) -> DataFrame:
    """(``doc``, ``legal_num``, ``num``): legal paragraphs with the technical ones of their section, less those already cited."""
    rows = paragraphs.withColumn("_l", legal)
    a = rows.where("_l").select("doc", "section", F.col("num").alias("legal_num"))
    b = rows.where("not _l").select("doc", "section", "num")
    done = cited.select("doc", F.col("citing").alias("legal_num"), F.explode("cited").alias("num"))
    return a.join(b, ["doc", "section"]).drop("section").join(done, ["doc", "legal_num", "num"], "left_anti")


def absorbed_units(missing: DataFrame, anchored: DataFrame, gap: int = 6) -> DataFrame:
    """(``doc``, ``number``, ``host``): each missing number with the nearest lower anchored one, ``gap`` below at most."""
    from .sequences import nearest_lower

    both = anchored.select("doc", "number", F.lit(True).alias("anchor")).unionByName(missing.select("doc", "number", F.lit(False).alias("anchor")))
    return nearest_lower(both, "doc", F.col("number"), F.col("anchor"), "number", gap).where("not anchor").select("doc", "number", "host")


def valid_cuts(cuts: DataFrame, least: int = 200) -> DataFrame:
    """(``doc``, ``host``, ``valid``) of ``cuts(doc, host, number, at, stop)``: whether a host's cuts all rise with their numbers and leave ``least`` characters each; one bad cut spoils them all."""
    order = W.partitionBy("doc", "host").orderBy("number")
    rises = F.coalesce(F.col("at") > F.lag("at").over(order), F.lit(True))
    room = F.coalesce(F.lead("at").over(order), F.col("stop")) - F.col("at") >= least
    return cuts.withColumn("_ok", rises & room).groupBy("doc", "host").agg(F.bool_and("_ok").alias("valid"))


def negatives(pairs: DataFrame, each: int = 1, seed: int = 42) -> DataFrame:
    """(``pair_id``, ``technical_text``, ``other_id``, ``executive_text``): findings with an executive text of the same document that names none of their numbers; chosen by hash, so the same every time."""
    a = pairs.select("source_doc_id", "pair_id", "technical_text", "finding_numbers", F.col("executive_text").alias("_own"))
    b = pairs.select("source_doc_id", F.col("pair_id").alias("other_id"), F.col("finding_numbers").alias("_other"), "executive_text")
    rows = a.join(b, "source_doc_id").where(~F.arrays_overlap("finding_numbers", "_other") & (F.col("_own") != F.col("executive_text")))
    order = W.partitionBy("pair_id").orderBy(F.sha1(F.concat_ws(":", F.lit(seed), "pair_id", "other_id")), "other_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select("pair_id", "technical_text", "other_id", "executive_text")


def event_pairs(filings: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings joined to their issuer's filing: the original before an amendment, then the earliest."""
    first = filings.withColumn("_r", F.row_number().over(W.partitionBy("issuer").orderBy((F.col("form") == "8-K").desc(), "filed", "filing_id"))).where("_r = 1").drop("_r")
    return findings.join(first, "issuer")


# --- planted errors ---


def mutants(pairs: DataFrame, source: str = "source_text", draft: str = "draft_text") -> DataFrame:
    """Each pair with one planted error per class that it allows: ``cls``, ``target`` (the check it is aimed at), ``base`` (a draft without it), ``mutant``, and the declared severities of both.

    Classes: id_swap, number_shift, entity_invent, severity_down, severity_up, caveat_delete.
    """
    from ..functions.text import BANDS, identifiers, numbers, sentences

    s, d = F.col(source), F.col(draft)
    ids, shared = identifiers(s), F.filter(numbers(s), lambda n: F.contains(d, n))
    names = {v: k for k, v in BANDS.items()}
    named = lambda band: F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), band)
    marked = F.get(F.filter(sentences(s), lambda x: x.rlike("(?i)" + "|".join(m.replace(" ", r"\s") for m in CAVEAT_MARKERS))), F.lit(0))
    none = F.lit(None).cast("string")

    def case(when: Column, cls: str, target: str, base: Column, mutant: Column, before: Column = none, after: Column = none) -> Column:
        return F.when(when, F.struct(F.lit(cls).alias("cls"), F.lit(target).alias("target"), base.alias("base"), mutant.alias("mutant"), before.alias("severity_base"), after.alias("severity_mutant")))

    band = let(severity(s), lambda x: x["band"])
    number = F.get(shared, F.lit(0))
    other = F.when(number == "4718", F.lit("8231")).otherwise(F.lit("4718"))
    shifted = F.regexp_replace(d, F.concat(F.lit(r"(?<![\d.])\Q"), number, F.lit(r"\E(?![\d.])")), other)
    cases = F.array(
        case((F.size(ids) == 1) & ~F.contains(d, F.get(ids, F.lit(0))), "id_swap", "id_parity", F.concat(d, F.lit(" (tracked as "), F.get(ids, F.lit(0)), F.lit(")")), d),
        case(F.size(shared) > 0, "number_shift", "numeric_parity", d, shifted),
        case(~F.contains(s, F.lit("10.13.37.42")), "entity_invent", "entity_check", d, F.concat(d, F.lit(" The affected host was 10.13.37.42."))),
        case(band >= 2, "severity_down", "severity_drift", d, d, named(band), named(F.greatest(band - 2, F.lit(0)))),
        case(band <= 3, "severity_up", "severity_drift", d, d, named(band), named(band + 1)),
        case(marked.isNotNull(), "caveat_delete", "caveat_parity", F.concat(d, F.lit(" "), marked), d),
    )
    keep = [c for c in pairs.columns]
    return pairs.select(*keep, F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("_m")).select(*keep, "_m.*")


def title_like(a: Column, b: Column) -> Column:
    """Whether two titles are alike: equal beginnings of their letters, or one within the other."""
    return _same_title(a, b)


def banner(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in the first 3000 characters."""
    return F.left(F.lower(squeezed(text)), F.lit(3000)).rlike("|".join(words))
