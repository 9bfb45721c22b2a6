"""Selectors: pairs that a model points out by quotes, kept only where each quote stands in the document; what failed is asked for once more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import let, matches, squeezed, verified_span
from ..sources.checkpoints import stored
from . import analytics
from .prepare import merged_spans

# Prices in dollars for a million tokens, the hard cap, items of an answer, and the least length of a quote.
PRICE_IN, PRICE_OUT, HARD_BUDGET = 0.50, 3.00, 3.0
MAX_ITEMS, LEAST_QUOTE = 6, 8
#: Fixed value: headings of sections that tell how something works.
TECH_HEADING = r"(?i)\b(Behaviors?|Behaviour|Exploitation|Mechanisms?|Technical details?|Vulnerabilit(y|ies)|How it works|Operation|Details)\b"


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * PRICE_IN + tokens_out * PRICE_OUT) / 1e6


# --- quotes in pairs, with retry, budget and manifest ---


def rescue(docs: DataFrame, answers: DataFrame, retries: DataFrame, order: list[str], cap: float = HARD_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Pairs of verified quotes, and a manifest with a row per document.

    ``docs(doc, text, ...)``; ``answers(doc, item, plain, technical, tokens_in, tokens_out, error)``, a row per pair that the
    model proposed (one with a null ``item`` for an answer without pairs); ``retries(doc, item, role, quote, tokens_in,
    tokens_out)`` holds what it says when asked again for one quote, ``role`` being ``plain`` or ``technical``.

    A quote is good if it stands in the text, but for white space, with eight characters or more. Only quotes that failed, and were
    not empty, meet the retries (an anti-join of the round before), once. Both quotes of a pair have to be good; of pairs with the same plain quote the
    first in ``order`` (columns of ``docs``) and by item stays. Of an answer the first six items count.

    Budget: documents are paid for in ``order`` while what all before have spent is within ``cap`` and the hard cap; the total is a
    distributed prefix sum. The first document beyond, and all after it, are ``budget_stop`` and give nothing. Other states: ``error``
    (the answer says so), ``pending`` (there is no answer), ``ok``. Pairs: ``doc``, ``item``, ``technical``, ``plain``, as they stand in the
    text, with ``start`` and ``stop`` of both. Documents' ids are unique; null texts hold no quote.
    """
    first = answers.where(F.col("item").isNull() | (F.col("item") < MAX_ITEMS))
    sides = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("quote")) for r in ("plain", "technical")])).alias("q")
    attempts = first.where("item is not null and error is null").select("doc", "item", sides).select("doc", "item", "q.*")
    texts = docs.select("doc", "text")
    found = lambda rows: rows.join(texts, "doc").withColumn("span", verified_span(F.col("text"), F.col("quote"), LEAST_QUOTE)).withColumn("slice", F.when(F.col("span").isNotNull(), F.substring("text", F.col("span.start") + 1, F.col("span.stop") - F.col("span.start")))).drop("text", "quote")
    tried = stored(found(attempts), "attempts")
    failed = tried.where("span is null").select("doc", "item", "role")
    again = stored(found(failed.join(attempts.where("quote <> ''").select("doc", "item", "role"), ["doc", "item", "role"]).join(retries, ["doc", "item", "role"])), "retried")

    spent_first = first.groupBy("doc").agg(F.max("tokens_in").alias("in1"), F.max("tokens_out").alias("out1"), F.max("error").alias("error"))
    spent_again = again.groupBy("doc").agg(F.count("*").alias("retry_calls"), F.sum("tokens_in").alias("in2"), F.sum("tokens_out").alias("out2"), F.count("span").alias("retry_saved"))
    asserted = tried.groupBy("doc").agg(F.count("*").alias("attempts"), F.count("span").alias("first_try_ok"))
    state = docs.drop("text").join(spent_first.withColumn("answered", F.lit(True)), "doc", "left").join(spent_again, "doc", "left").join(asserted, "doc", "left")
    zero = ["in1", "out1", "in2", "out2", "retry_calls", "retry_saved", "attempts", "first_try_ok"]
    state = state.fillna(0, zero).withColumn("cost", cost(F.col("in1") + F.col("in2"), F.col("out1") + F.col("out2")))
    state = analytics.running_total(state.withColumn("micro", F.round(F.col("cost") * 1e9).cast("bigint")), order, "micro", "total")
    before = F.col("total") - F.col("micro")
    status = F.when(before > int(round(min(cap, HARD_BUDGET) * 1e9)), "budget_stop").when(F.col("answered").isNull(), "pending").when(F.col("error").isNotNull(), "error").otherwise("ok")
    state = stored(state.withColumn("status", status), "state")

    good = tried.where("span is not null").select("doc", "item", "role", "span", "slice").unionByName(again.where("span is not null").select("doc", "item", "role", "span", "slice"))
    side = lambda role: F.max(F.when(F.col("role") == role, F.struct("span", "slice"))).alias(role)
    pairs = good.groupBy("doc", "item").agg(side("plain"), side("technical")).where("plain is not null and technical is not null")
    paid = pairs.join(state.where("status = 'ok'").select("doc", *[c for c in order if c != "doc"]), "doc")
    # Of equal plain quotes the least place in order, by aggregation: a phrase that very many documents share is no hot group.
    place = F.struct(*[c for c in order if c != "doc"], "doc", "item") if "doc" not in order else F.struct(*order, "item")
    keyed = paid.withColumn("k", F.sha2(squeezed(F.col("plain.slice")), 256))
    firsts = keyed.groupBy("k").agg(F.min(place).alias("p")).select("p.doc", "p.item", F.lit(True).alias("kept"))
    settled = stored(keyed.join(firsts, ["doc", "item"], "left"), "settled")
    out = settled.where("kept").select("doc", "item", F.col("technical.slice").alias("technical"), F.col("plain.slice").alias("plain"), F.col("technical.span").alias("technical_span"), F.col("plain.span").alias("plain_span"))
    emitted = settled.groupBy("doc").agg(F.count_if("kept").alias("pairs_emitted"), F.count_if(F.col("kept").isNull()).alias("pairs_dedup_skipped"))
    manifest = state.join(emitted, "doc", "left").fillna(0, ["pairs_emitted", "pairs_dedup_skipped"])
    live = F.col("status") != "budget_stop"
    counts = ["retry_calls", "retry_saved", "attempts", "first_try_ok"]
    shown = {c: F.when(live, F.col(c)).otherwise(F.lit(0)) for c in counts} | {"tokens_in": F.when(live, F.col("in1") + F.col("in2")).otherwise(F.lit(0)), "tokens_out": F.when(live, F.col("out1") + F.col("out2")).otherwise(F.lit(0))} | {"calls": F.when(live & F.col("answered"), 1 + F.col("retry_calls")).otherwise(F.lit(0)), "cost_usd": F.round(F.when(live, F.col("cost")).otherwise(0.0), 5)}
    manifest = manifest.withColumns(shown).withColumn("failures", F.col("attempts") - F.col("first_try_ok") - F.col("retry_saved"))
    return out, manifest.select("doc", "status", "calls", *counts, "failures", "pairs_emitted", "pairs_dedup_skipped", "tokens_in", "tokens_out", "cost_usd")


# --- spans of a lead, and the section that explains them ---


def _tokens(text: Column) -> Column:
    return F.array_distinct(matches(F.lower(text), "[a-z]{4,}"))


def headed(text: Column, heading: str = r"(?m)^(=+)[ \t]*(\S.*?)[ \t]*\1[ \t]*$") -> Column:
    """``struct<lead, sections>``: what stands before the first heading, and each section with ``level``, ``title``, ``start`` and ``stop`` (from 0), a section reaching over those below it."""

    def cut(found: Column) -> Column:
        at = F.aggregate(found, F.struct(F.lit(1).alias("from"), F.expr("cast(array() as array<int>)").alias("at")), lambda s, h: let(F.call_function("locate", h, text, s["from"]), lambda k: F.struct((k + F.length(h)).cast("int").alias("from"), F.concat(s["at"], F.array((k - 1).cast("int"))).alias("at"))))

        def sections(places: Column) -> Column:
            level = lambda i: F.length(F.regexp_extract(F.get(found, i), "^=+", 0))
            later = lambda i: F.filter(F.sequence(i + 1, F.size(found)), lambda j: (j < F.size(found)) & (level(j) <= level(i)))
            stop = lambda i: let(later(i), lambda x: F.coalesce(F.get(places, F.get(x, F.lit(0))), F.length(text)))
            title = lambda i: F.trim(F.regexp_replace(F.get(found, i), "^=+|=+[ \t]*$", ""))
            return F.transform(found, lambda h, i: F.struct(level(i).alias("level"), title(i).alias("title"), F.get(places, i).alias("start"), stop(i).cast("int").alias("stop")))

        return let(at["at"], lambda places: F.struct(F.left(text, F.coalesce(F.get(places, F.lit(0)), F.length(text))).alias("lead"), sections(places).alias("sections")))

    return let(F.regexp_extract_all(text, F.lit(heading), F.lit(0)), cut)


def select_spans(docs: DataFrame, answers: DataFrame, retries: DataFrame) -> DataFrame:
    """One row per document of ``docs(doc, text)``: the passages of its lead that quotes point at, and the section that explains them.

    ``answers`` and ``retries`` have ``doc``, ``kind`` (``mechanism`` or ``impact``) and ``quote``; the second is what the model says when
    asked again, and only documents that returned mechanism quotes none of which is good (an anti-join) meet it. Quotes are verified in
    the lead as it is: a quote with other white space finds its place, and ``spans`` are offsets of the original text. Spans that only
    white space parts are one slice, cut from the text; others are joined by a space. The section is that with a technical heading, and
    what is below it, that shares most words with the passages, the first on a tie. ``status``: ``ok``, ``no_mechanism_verified``, ``no_tech_section``.
    """
    parts = stored(docs.select("doc", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", headed(F.col("text"))), "parts")
    lead = parts.select("doc", F.col("h.lead").alias("lead"))
    checked = lambda quotes: quotes.join(lead, "doc").select("doc", "kind", verified_span(F.col("lead"), F.col("quote")).alias("span"))
    summed = lambda rows: rows.groupBy("doc").agg(F.count("*").alias("returned"), F.count("span").alias("verified"), F.count_if(F.col("kind") == "mechanism").alias("n_mechanism"), F.array_sort(F.collect_set(F.when(F.col("kind") == "mechanism", F.col("span")))).alias("spans"))
    first = stored(summed(checked(answers)), "first")
    short = first.where((F.col("n_mechanism") > 0) & (F.size("spans") == 0)).select("doc")
    second = summed(checked(retries.join(short, "doc", "left_semi"))).where(F.size("spans") > 0).select("doc", F.col("spans").alias("again"))
    asked_again = short.withColumn("retried", F.lit(True))
    all = parts.join(first, "doc", "left").join(second, "doc", "left").join(asked_again, "doc", "left")
    all = all.withColumn("spans", F.coalesce("again", "spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)"))).withColumn("passage", F.when(F.size("spans") > 0, merged_spans(F.col("text"), F.col("spans"))))

    def nearest(words: Column) -> Column:
        of = lambda s: F.size(F.array_intersect(words, _tokens(F.substring(F.col("text"), s["start"] + F.length(s["title"]) + 2 * s["level"] + 1, s["stop"] - s["start"]))))
        told = F.filter("h.sections", lambda s: s["title"].rlike(TECH_HEADING))
        return F.array_max(F.transform(told, lambda s, i: F.struct(of(s).alias("score"), (-i).alias("i"), s.alias("s"))))

    best = F.when(F.col("passage").isNotNull(), let(_tokens(F.coalesce("passage", F.lit(""))), nearest))
    all = stored(all.withColumn("best", best), "selected")
    status = F.when(F.col("passage").isNull(), "no_mechanism_verified").when(F.col("best").isNull(), "no_tech_section").otherwise("ok")
    section = F.when(status == "ok", F.trim(F.substring("text", F.col("best.s.start") + 1, F.col("best.s.stop") - F.col("best.s.start"))))
    return all.select("doc", status.alias("status"), F.coalesce("retried", F.lit(False)).alias("retried"), F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("verified", F.lit(0)).alias("verified"), "spans", F.when(status == "ok", F.col("passage")).alias("passage"), F.when(status == "ok", F.col("best.s.title")).alias("heading"), section.alias("section"))
