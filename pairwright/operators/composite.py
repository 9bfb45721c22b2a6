"""Whole extractions of one kind of document each: audits, reports by firm, advisories, and sentences matched by vectors within a document. Every document that gives no pair has a reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import is_quantified, let, matches, prose_sentences, strip
from .extract import HEADING, best_match
from .prepare import stripped
from .sequences import html_sections

# Headings by which sections are known, and lengths that make a section plausible.
AUDIT_SUMMARY, AUDIT_FINDINGS = r"(?i)^(?:results in brief|executive summary|what we found)", r"(?i)^(?:findings|results and recommendations|audit results)"
SUMMARY_STOP = r"(?i)^(?:background|introduction|objective|scope|methodology|appendi|management|findings|results and recommendations|audit results)"
AUDIT_STOP, INTRO = r"(?i)^(?:appendi|management (?:comments|response)|objective)", r"(?i)^(?:i{1,3}\.?\s*)?(?:background|introduction)\s*$"
GENERIC_SUMMARY, GENERIC_FINDINGS = r"(?i)^#{1,6}\s*.*(?:executive|summary)", r"(?i)^#{1,6}\s*.*(?:findings|vulnerabilit|results)"
GENERIC_STOP = r"(?i)^#{1,6}\s*(?:\d+(?:\.\d+)*\.?\s+)?.*(?:scope|methodology|introduction|table of contents|appendix|findings|results|technical)"
ADVISORY_SUMMARY, ADVISORY_RISK, ADVISORY_DETAILS = r"(?i)^(?:executive )?summary", r"(?i)^risk evaluation", r"(?i)^technical details"
STOP_LEAST, BODY_LEAST, BODY_MOST, POSITIONAL_LEAST, FINDINGS_LEAST = 300, 200, 9000, 1500, 400


def outline(text: Column) -> Column:
    """``struct<n, upto, heads>``: a text's number of lines, its length plus 1, and of each heading its line ``n``, the characters ``upto`` it, its ``size`` and its ``title``. Null for a null text.

    The text is cut before each ``#`` that begins a line, so what is gone through one by one is its headings, not its lines.
    """
    first = lambda p: F.substring_index(p, "\n", 1)
    head = lambda s, p: F.struct(s["n"].alias("n"), s["upto"].alias("upto"), F.length(first(p)).alias("size"), strip(F.regexp_extract(first(p), HEADING, 1)).alias("title"))
    is_head = lambda p: p.startswith("#") & first(p).rlike(HEADING)
    step = lambda s, p: F.struct(
        (s["n"] + F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1).alias("n"), (s["upto"] + F.length(p) + 1).alias("upto"), F.when(is_head(p), F.concat(s["heads"], F.array(head(s, p)))).otherwise(s["heads"]).alias("heads")
    )
    none = F.array().cast("array<struct<n:int,upto:int,size:int,title:string>>")
    return F.aggregate(F.split(text, r"\n(?=#)"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"), none.alias("heads")), step)


def _place(at: Column) -> Column:
    return F.struct(at["n"].alias("n"), at["upto"].alias("upto"))


def _first(heads: Column, keep) -> Column:
    return F.get(F.filter(heads, keep), F.lit(0))


def _titled(heads: Column, pattern: str) -> Column:
    return F.filter(heads, lambda h: h["title"].rlike(pattern))


def _text(text: Column, start: Column, stop: Column) -> Column:
    """The lines of a span of an outline, without the newline behind them; null where it has none."""
    return F.when(start["n"] < stop["n"], F.substr(text, start["upto"] + 1, stop["upto"] - start["upto"] - 1))


def plausible_span(o: Column, begin: str, end: str, stop_least: int = STOP_LEAST, least: int = BODY_LEAST, most: int = BODY_MOST) -> Column:
    """``struct<start, stop>``, places in an outline: the first heading that matches ``begin`` with a body of ``least`` to ``most`` characters, else the first that matches at all; null without one.

    A body goes to the first heading that matches ``end`` with ``stop_least`` characters before it, else to the
    first that matches, else to the document's end. An entry of a table of contents has no body, so it loses.
    """
    size = lambda a, z: z["upto"] - a["upto"] - 1

    def span(start: Column, stops: Column) -> Column:
        far, near = _first(stops, lambda s: (s["n"] > start["n"]) & (size(start, s) >= stop_least)), _first(stops, lambda s: s["n"] > start["n"])
        return F.struct(_place(start).alias("start"), F.coalesce(_place_or_null(far), _place_or_null(near), _place(o)).alias("stop"))

    spans = let(_titled(o["heads"], end), lambda stops: F.transform(_titled(o["heads"], begin), lambda s: span(s, stops)))
    return let(spans, lambda x: F.coalesce(_first(x, lambda s: size(s["start"], s["stop"]).between(least, most)), F.get(x, F.lit(0))))


def _place_or_null(at: Column) -> Column:
    return F.when(at.isNotNull(), _place(at))


def first_plausible(docs: DataFrame, begin: str, end: str, stop_least: int = STOP_LEAST, least: int = BODY_LEAST, most: int = BODY_MOST, doc: str = "doc", text: str = "text") -> DataFrame:
    """(``doc``, ``start``, ``stop``): the lines of each document's plausible span; no row for a document without one. One projection."""
    rows = docs.select(F.col(doc).alias("doc"), outline(F.col(text)).alias("o")).withColumn("x", plausible_span(F.col("o"), begin, end, stop_least, least, most))
    return rows.where("x is not null").select("doc", F.col("x.start.n").alias("start"), F.col("x.stop.n").alias("stop"))


def _audits(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(``doc``, ``text``, ``o``, ``summary``, ``named``): an outline, the summary's span, and the first findings heading after the summary, else the first at all."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).withColumn("o", outline(F.col("text"))).withColumn("summary", plausible_span(F.col("o"), AUDIT_SUMMARY, SUMMARY_STOP))
    named = let(_titled(F.col("o.heads"), AUDIT_FINDINGS), lambda f: F.coalesce(_first(f, lambda h: h["n"] >= F.col("summary.stop.n")), F.get(f, F.lit(0))))
    return rows.withColumn("named", named)


def audit_pairs(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """A row per document: ``executive_text`` and ``technical_text`` of an audit, ``needs_llm_verify``, and ``reason`` where there is no pair.

    Findings are what stands under their heading; where no heading names them, what follows the summary up to a
    stop, a background section left out, if that is long enough, and then to be verified. All in one reading of the
    documents: sections are cut by the places of their headings, without a row for a line.
    """
    rows, from_ = _audits(docs, doc, text), F.col("summary.stop")
    after = F.filter("o.heads", lambda h: h["n"] >= from_["n"])
    intro = _first(after, lambda h: h["title"].rlike(INTRO))["n"]
    behind = let(intro, lambda n: _first(F.col("o.heads"), lambda h: h["n"] > n))
    rows = rows.withColumn("start", F.when(F.col("named").isNotNull(), _place(F.col("named"))).otherwise(F.coalesce(_place_or_null(behind), from_)))
    stop = _first(F.col("o.heads"), lambda h: (h["n"] > F.col("start.n")) & h["title"].rlike(AUDIT_STOP))
    rows = rows.withColumn("stop", F.coalesce(_place_or_null(stop), _place(F.col("o"))))
    rows = rows.select("doc", stripped(_text(F.col("text"), F.col("summary.start"), from_)).alias("executive_text"), stripped(_text(F.col("text"), F.col("start"), F.col("stop"))).alias("technical_text"), F.col("named").isNull().alias("loose"))
    positional = F.col("loose") & F.col("technical_text").isNotNull()
    n, m = F.coalesce(F.length("executive_text"), F.lit(0)), F.coalesce(F.length("technical_text"), F.lit(0))
    reason = F.when(F.col("executive_text").isNull(), "no summary section").when(n < BODY_LEAST, "summary too short").when(n > BODY_MOST, "summary too long").when(m < F.when(positional, POSITIONAL_LEAST).otherwise(FINDINGS_LEAST), "findings too short")
    return rows.select("doc", F.left("executive_text", F.lit(8000)).alias("executive_text"), F.left("technical_text", F.lit(12000)).alias("technical_text"), positional.alias("needs_llm_verify"), reason.alias("reason"))


def audit_claims(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(``doc``, ``claim``, ``finding``, ``score``): summary sentences of 40 characters or more with a quantity, each with the finding whose title and first 500 characters share most significant words with it."""
    rows = _audits(docs, doc, text)
    summary = stripped(_text(F.col("text"), F.col("summary.start"), F.col("summary.stop")))
    claims = rows.where("summary is not null").select("doc", F.explode(prose_sentences(summary)).alias("claim")).where(is_quantified(F.col("claim")) & (F.length("claim") >= 40)).distinct()
    heads = rows.select("doc", "text", _place(F.col("o")).alias("end"), F.filter("o.heads", lambda h: h["n"] > F.col("named.n")).alias("heads"))
    cut = lambda h, i: F.struct(h["n"].alias("n"), h["title"].alias("title"), F.struct((h["n"] + 1).alias("n"), (h["upto"] + h["size"] + 1).alias("upto")).alias("start"), F.coalesce(_place_or_null(F.get(F.col("heads"), i + 1)), F.col("end")).alias("stop"))
    cuts = heads.select("doc", "text", F.explode(F.transform("heads", cut)).alias("c")).where(~F.col("c.title").rlike(AUDIT_STOP))
    # Of each body no more than the first 500 characters can be among those of all bodies of a title.
    bodies = cuts.select("doc", F.col("c.title").alias("title"), F.col("c.n").alias("n"), F.left(_text(F.col("text"), F.col("c.start"), F.col("c.stop")), F.lit(500)).alias("t")).where("t is not null")
    targets = bodies.groupBy("doc", "title").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x")).select("doc", F.col("title").alias("target"), F.concat_ws(" ", "title", F.left(F.array_join(F.transform("x", lambda x: x["t"]), "\n"), F.lit(500))).alias("text"))
    return best_match(claims.select("doc", "claim", F.col("claim").alias("text")), targets).select("doc", "claim", F.col("target").alias("finding"), "score")


def profiled_sections(docs: DataFrame, profiles: DataFrame, doc: str = "doc", firm: str = "firm", text: str = "text", summary_least: int = 400, findings_least: int = 800) -> DataFrame:
    """(``doc``, ``executive_text``, ``technical_text``) by the firm's own headings of ``profiles(firm, exec_rx, findings_rx)``, else by the general ones. The summary ends where the findings begin, if they follow, else at the next heading of another kind. Documents with thin sections, or of a firm without a profile, have no row."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(firm).alias("firm"), F.split(F.col(text), "\n").alias("l")).join(F.broadcast(profiles), "firm")
    first = lambda rx: F.array_min(F.filter(F.transform("l", lambda x, i: F.when(F.regexp_like(x, rx), i)), lambda i: i.isNotNull()))
    rows = rows.withColumns({"e": F.coalesce(first(F.col("exec_rx")), first(F.lit(GENERIC_SUMMARY))), "f": F.coalesce(first(F.col("findings_rx")), first(F.lit(GENERIC_FINDINGS)))}).where("e is not null and f is not null")
    stop = F.array_min(F.filter(F.transform("l", lambda x, i: F.when((i > F.col("e")) & x.rlike(GENERIC_STOP), i)), lambda i: i.isNotNull()))
    end = F.when(F.col("f") > F.col("e"), F.col("f")).otherwise(F.coalesce(stop, F.size("l")))
    part = lambda a, z: F.array_join(F.slice("l", a + 1, z - a), "\n")
    out = rows.withColumn("end", end).select("doc", strip(F.regexp_replace(part(F.col("e"), F.col("end")), r"(?m)^#{1,6}\s*", "")).alias("executive_text"), F.left(part(F.col("f"), F.size("l")), F.lit(12000)).alias("technical_text"))
    return out.where((F.length("executive_text") >= summary_least) & (F.length("technical_text") >= findings_least))


def advisory_pairs(pages: DataFrame, id: str, html: str, with_risk: Column, summary_least: int = 150, details_least: int = 400) -> DataFrame:
    """(id, ``executive_text``, ``technical_text``) of an advisory's first sections of each kind; its risk evaluation goes to the summary ``with_risk``."""
    body = lambda rx: F.get(F.filter("s", lambda x: x["heading"].rlike(rx)), F.lit(0))["body"]
    rows = pages.select(id, html_sections(F.col(html)).alias("s"), with_risk.alias("_r"))
    summary = F.concat_ws("\n\n", F.nullif(body(ADVISORY_SUMMARY), F.lit("")), F.when(F.col("_r"), F.nullif(body(ADVISORY_RISK), F.lit(""))))
    return rows.select(id, summary.alias("executive_text"), body(ADVISORY_DETAILS).alias("technical_text")).where((F.length("executive_text") >= summary_least) & (F.length("technical_text") >= details_least))


#: Pairs that a task scores at a time, which bounds its memory at some 20 MB beside the document's own vectors.
_PAIRS = 1 << 18
#: Cosines are ranked when rounded to six places; what is below the k-th by more than this cannot be among the best.
_ROUNDING = 1.1e-6


def nearest_within(sentences: DataFrame, targets: DataFrame, k: int = 5, least: float | None = None, apart: str | None = None) -> DataFrame:
    """(``doc``, ``sentence``, ``target``, ``cosine``, ``rank``): for ``sentences(doc, sentence, v)`` the ``k`` nearest ``targets(doc, target, v)`` of the same document, by vectors of length 1, ties by target; not those of the same ``apart``, and none below ``least``.

    Both are shuffled by document once, in order. A task scores the pairs of a document in arrays and keeps what can be among the best of
    a sentence, so no row is made for a pair: a few for each sentence, or ``k`` for each distinct cosine within rounding of the k-th.
    """
    own, other = dict(sentences.dtypes)["sentence"], dict(targets.dtypes)["target"]
    kind = (F.col(apart).cast("string") if apart else F.lit(None).cast("string")).alias("kind")
    v = F.col("v").cast("array<double>").alias("v")
    rows = sentences.select("doc", F.lit(False).alias("found"), "sentence", F.lit(None).cast(other).alias("target"), v, kind).unionByName(targets.select("doc", F.lit(True).alias("found"), F.lit(None).cast(own).alias("sentence"), "target", v, kind))
    ordered = rows.where("doc is not null").repartition("doc").sortWithinPartitions("doc", "found", "sentence", "target")
    near = ordered.mapInArrow(_nearest_of_doc(k, bool(apart)), f"doc {dict(rows.dtypes)['doc']}, sentence {own}, target {other}, dot double")
    scored = near.select("doc", "sentence", "target", F.round("dot", 6).alias("cosine"))
    if least is not None:
        scored = scored.where(F.col("cosine") >= least)
    order = W.partitionBy("doc", "sentence").orderBy(F.desc("cosine"), "target")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc", "sentence", "target", "cosine", "rank")


def _nearest_of_doc(k: int, apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of their documents, sentences before targets, the pairs that can be among a sentence's ``k`` nearest; equal sentences of a document count once."""

    def codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Equal numbers for equal values, -1 for null."""
        return pa.array(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors side by side, a row for each component, and their lengths, -1 where a vector or one of its components is null."""
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values, first = vectors.flatten(), np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((int(sizes.max(initial=0)), len(sizes)))
        out[np.arange(len(row)) - first[row], row] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
        widths = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, sizes)
        widths[row[values.is_null().to_numpy(zero_copy_only=False)]] = -1
        return out, widths

    def best(query: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Places, of each query's pairs, of those within rounding of the k-th; of equal ones the first ``k``. Queries are in order."""
        order = np.lexsort((-value, query))
        value, at = value[order], np.arange(len(order))
        first = np.searchsorted(query, query)
        last = np.searchsorted(query, query, side="right") - 1
        kth = np.where(last - first + 1 >= k, value[np.minimum(first + k - 1, last)], -np.inf)
        same = at - np.maximum.accumulate(np.where((at == first) | np.r_[True, value[1:] != value[:-1]], at, 0))
        return order[(value >= kth - _ROUNDING) & (same < k)]

    def pairs(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        doc, said, found = codes(column("doc")), codes(column("sentence")), column("found").to_numpy(zero_copy_only=False)
        again = np.r_[False, (doc[1:] == doc[:-1]) & (said[1:] == said[:-1]) & ~found[1:]]
        s, t = np.flatnonzero(~found & ~again), np.flatnonzero(found)
        v, widths = matrix(column("v"))
        a, b, kinds = v[:, s], v[:, t], codes(column("kind"))
        first = np.searchsorted(doc[t], doc[s])
        count = np.searchsorted(doc[t], doc[s], side="right") - first
        upto = np.cumsum(count)
        start = 0
        while start < len(s):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + _PAIRS, side="right")))
            n = count[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            j = np.arange(len(i)) - np.repeat(upto[start:stop] - n - done, n) + np.repeat(first[start:stop], n)
            start = stop
            if apart:
                other = (kinds[s[i]] != kinds[t[j]]) & (kinds[s[i]] >= 0) & (kinds[t[j]] >= 0)
                i, j = i[other], j[other]
            if not len(i):
                continue
            dot = np.zeros(len(i))
            with np.errstate(all="ignore"):
                for x, y in zip(a, b, strict=True):  # in the order of the components, like ``dot``
                    dot += x[i] * y[j]
            unknown = (widths[s[i]] != widths[t[j]]) | (widths[s[i]] < 0)
            kept = best(i, np.where(unknown, -np.inf, np.where(np.isnan(dot), np.inf, dot)))
            i, j = i[kept], j[kept]
            yield pa.RecordBatch.from_arrays([column("doc").take(pa.array(s[i])), column("sentence").take(pa.array(s[i])), column("target").take(pa.array(t[j])), pa.array(dot[kept], mask=unknown[kept])], ["doc", "sentence", "target", "dot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the last document, of which more may come
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc")
            if waiting and waiting[0].column("doc")[0] == doc[-1]:
                waiting.append(batch)
                continue
            code = codes(doc)
            start = int(np.argmax(code == code[-1]))
            whole = [*waiting, batch.slice(0, start)] if start else waiting
            if whole:
                yield from pairs(whole)
            waiting = [batch.slice(start)]
        if waiting:
            yield from pairs(waiting)

    return run


def recovered_units(regions: DataFrame, cuts: DataFrame, span: int = 6, least: int = 200) -> DataFrame:
    """Findings that another one's text has swallowed, cut out where a model says they begin, if four tests hold.

    ``regions(doc, host, text)``; ``cuts(doc, host, number, first_line)``. First: the line stands in the region, white space around it aside (its first
    place counts), and the number is at most ``span`` above the host's. Second: the cuts of a region come in the order of their numbers, or
    none of them counts. Third: a cut is not after the finding's own first figure (``Figure 3.1``), nor within the host's. Fourth: what is cut out, up
    to the next cut or the end, and what is left of the host, are of ``least`` characters or more. (``doc``, ``host``, ``number``, ``text``).
    """
    lines = regions.select("doc", "host", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    asked = cuts.where((F.col("number") > F.col("host")) & (F.col("number") - F.col("host") <= span) & (F.trim("first_line") != "")).select("doc", "host", "number", strip(F.col("first_line")).alias("line"))
    found = lines.withColumn("line", strip(F.col("t"))).join(asked, ["doc", "host", "line"]).groupBy("doc", "host", "number").agg(F.min("n").alias("n"))
    by = W.partitionBy("doc", "host")
    backward = F.coalesce(F.col("n") < F.lag("n").over(by.orderBy("number")), F.lit(False)).cast("int")
    ordered = found.withColumn("back", backward).withColumn("back", F.max("back").over(by)).where("back = 0").drop("back")
    figures = lines.select("doc", "host", "n", F.explode(matches(F.col("t"), r"Figure (\d+)\.\d", 1)).alias("figure")).select("doc", "host", "n", F.col("figure").cast("int").alias("number"))
    own = figures.groupBy("doc", "host", "number").agg(F.min("n").alias("own"))
    hosts = figures.where(F.col("number") == F.col("host")).groupBy("doc", "host").agg(F.max("n").alias("last"))
    sound = ordered.join(own, ["doc", "host", "number"], "left").join(hosts, ["doc", "host"], "left").where((F.col("own").isNull() | (F.col("n") <= F.col("own"))) & (F.col("last").isNull() | (F.col("n") > F.col("last"))))
    bounds = sound.select("doc", "host", "number", "n", F.lead("n").over(by.orderBy("n", "number")).alias("stop"), F.min("n").over(by).alias("first"))
    cut = bounds.join(regions, ["doc", "host"]).withColumn("l", F.split("text", "\n"))
    part = lambda a, b: strip(F.array_join(F.slice("l", a + 1, b - a), "\n"))
    out = cut.select("doc", "host", "number", part(F.col("n"), F.coalesce("stop", F.size("l"))).alias("text"), part(F.lit(0), F.col("first")).alias("left"))
    return out.where((F.length("text") >= least) & (F.length("left") >= least)).select("doc", "host", "number", "text")
