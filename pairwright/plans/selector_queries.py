"""Queries of selection by verified quotes, of budgets, of samples by class and of tables that are replaced whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, prepare, selectors
from ..sources import rewrite
from ..sources.checkpoints import shared_folder
from .pairs import table

Query = Callable[[SparkSession, str], DataFrame]
_CAP = 0.06


def _talks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text").withColumn("w", T.matches(F.col("text"), r"\S+"))


def _rescued(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turns as documents, and answers made of their words: some quotes spoilt, some mended when asked again, some turns without an answer or with an error."""
    talks = _talks(spark, folder)
    words = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    items = talks.where("doc % 11 <> 0").select("doc", "text", "w", F.explode(F.array(*map(F.lit, range(3)))).alias("item"))
    plain, technical = words(4 * F.col("item") + 1, 4), words(4 * F.col("item") + 3, 6)
    answers = items.select(
        "doc", "item", F.when((F.col("doc") + F.col("item")) % 3 == 0, F.concat(plain, F.lit(" zzqq"))).otherwise(plain).alias("plain"), technical.alias("technical"),
        F.floor(F.length("text") / 4).alias("tokens_in"), F.lit(40).cast("bigint").alias("tokens_out"), F.when(F.col("doc") % 13 == 0, "timeout").alias("error"),
    )
    again = F.array(F.struct(F.lit("plain").alias("role"), F.when(F.col("doc") % 2 == 0, plain).otherwise("zzqq zzqq").alias("quote")), F.struct(F.lit("technical").alias("role"), technical.alias("quote")))
    retries = items.select("doc", "item", F.explode(again).alias("r")).select("doc", "item", "r.*", F.lit(30).cast("bigint").alias("tokens_in"), F.lit(10).cast("bigint").alias("tokens_out"))
    return selectors.rescue(talks.select("doc", "text"), answers, retries, ["doc"], _CAP)


def rescued_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that quotes point out in the turns, where both quotes stand."""
    pairs, _ = _rescued(spark, folder)
    return pairs.select("doc", "item", F.md5("plain").alias("plain_md5"), F.md5("technical").alias("technical_md5"), F.col("plain_span.start").alias("start"), F.col("plain_span.stop").alias("stop"))


def rescue_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each turn: calls, quotes found at once and when asked again, pairs, tokens, and where the budget ended."""
    return _rescued(spark, folder)[1].drop("cost_usd")


def selected_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: passages of the lead by quotes across line breaks, and the technical section."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text").withColumn("w", T.matches(F.col("text"), r"\S+"))
    text = F.col("text")
    tail = F.concat(F.lit("\n== Technical details ==\n"), F.right(text, F.lit(200)), F.lit("\n=== Operation ===\n"), F.left(text, F.lit(100)))
    articles = docs.select("doc", F.concat(text, F.lit("\n== History ==\n"), F.upper(F.left(text, F.lit(40))), F.when(F.col("doc") % 5 == 0, F.lit("")).otherwise(tail)).alias("text"))
    words = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    spoilt = lambda q: F.when(F.col("doc") % 3 == 0, F.concat(q, F.lit(" zzqq"))).otherwise(q)
    said = lambda kind, q: F.struct(F.lit(kind).alias("kind"), q.alias("quote"))
    answers = docs.select("doc", F.explode(F.array(said("mechanism", spoilt(words(3, 8))), said("mechanism", spoilt(words(13, 5))), said("impact", words(1, 4)))).alias("a")).select("doc", "a.*")
    retries = docs.select("doc", F.lit("mechanism").alias("kind"), F.when(F.col("doc") % 2 == 0, words(3, 8)).otherwise("zzqq zzqq").alias("quote"))
    out = selectors.select_spans(articles, answers, retries)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return out.select(F.col("doc").alias("doc_id"), "status", "retried", "returned", "verified", spans.alias("spans"), F.md5("passage").alias("passage_md5"), "heading", F.md5("section").alias("section_md5"))


def budget_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """A budget over all orders in order of date: how many of each year are paid for, and what was spent when the year ended."""
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey", F.floor("o_totalprice").alias("cost"))
    paid = analytics.within_budget(orders, ["o_orderdate", "o_orderkey"], "cost", 100_000_000)
    return paid.groupBy(F.year("o_orderdate").alias("year")).agg(F.count_if("paid").alias("n_paid"), F.count("*").alias("n"), F.max("spent").alias("spent"))


def sanity_set(spark: SparkSession, folder: str) -> DataFrame:
    """25 documents of each quality, and as many made wrong: the start of one with the text of another of its source."""
    pool = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("pair_id"), "source", "quality", F.col("text").alias("source_text"), F.left("text", F.lit(60)).alias("draft_text"))
    right = analytics.sample_by_class(pool, "quality", "pair_id", 25, 42)
    wrong = analytics.made_negatives(right, pool, "source", "pair_id", "source_text", "draft_text", 42)
    both = right.withColumn("gold", F.lit("aligned")).unionByName(wrong.withColumn("gold", F.lit("unaligned")))
    return both.select("pair_id", "gold", "quality", F.md5("source_text").alias("source_md5"), F.md5("draft_text").alias("draft_md5"))


def filled_blanks(spark: SparkSession, folder: str) -> DataFrame:
    """A table of documents whose language is blank for every third, rewritten in place with every sixth filled."""
    docs, path = table(spark, folder, "documents").select("doc_id", "lang"), f"{shared_folder(spark)}/blanks-{uuid.uuid4().hex}"
    docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang"))).write.parquet(path)
    fill = lambda rows: prepare.with_filled_blanks(rows, docs.where("doc_id % 6 = 0"), "doc_id", ["lang"])
    return rewrite.rewrite(spark, path, fill, rewrite.only_blanks_filled("doc_id", ["lang"]))


QUERIES: dict[str, Query] = {f.__name__: f for f in (rescued_pairs, rescue_manifest, selected_spans, budget_in_order, sanity_set, filled_blanks)}

_RESCUE = r"""t AS (SELECT conv_id * 1000 + turn AS doc, text, regexp_extract_all(text, '\S+') AS w, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM conversations),
  items AS (SELECT doc, text, norm, k, array_to_string(w[4 * k + 1 : 4 * k + 4], ' ') AS plain, array_to_string(w[4 * k + 3 : 4 * k + 8], ' ') AS technical FROM t, (SELECT unnest(range(3)) AS k) WHERE doc % 11 <> 0 AND doc % 13 <> 0),
  q AS (SELECT doc, text, norm, k, 'plain' AS role, plain AS quote, CASE WHEN (doc + k) % 3 = 0 THEN plain || ' zzqq' ELSE plain END AS q1, CASE WHEN doc % 2 = 0 THEN plain ELSE 'zzqq zzqq' END AS q2 FROM items
        UNION ALL SELECT doc, text, norm, k, 'technical', technical, technical, technical FROM items),
  v AS (SELECT *, length(q1) >= 8 AND contains(norm, q1) AS ok1, length(q2) >= 8 AND contains(norm, q2) AS ok2 FROM q),
  r AS (SELECT doc, count(*) AS attempts, count(*) FILTER (ok1) AS first_try_ok, count(*) FILTER (NOT ok1 AND q1 <> '') AS retry_calls, count(*) FILTER (NOT ok1 AND q1 <> '' AND ok2) AS retry_saved FROM v GROUP BY 1),
  s AS (SELECT t.doc, coalesce(attempts, 0) AS attempts, coalesce(first_try_ok, 0) AS first_try_ok, coalesce(retry_calls, 0) AS retry_calls, coalesce(retry_saved, 0) AS retry_saved,
          CASE WHEN t.doc % 11 = 0 THEN 0 ELSE CAST(floor(length(text) / 4) AS BIGINT) + 30 * coalesce(retry_calls, 0) END AS tin, CASE WHEN t.doc % 11 = 0 THEN 0 ELSE 40 + 10 * coalesce(retry_calls, 0) END AS tout, tin * 500 + tout * 3000 AS nano FROM t LEFT JOIN r USING (doc)),
  b AS (SELECT *, sum(nano) OVER (ORDER BY doc) - nano AS before FROM s),
  st AS (SELECT *, CASE WHEN before > 60000000 THEN 'budget_stop' WHEN doc % 11 = 0 THEN 'pending' WHEN doc % 13 = 0 THEN 'error' ELSE 'ok' END AS status FROM b),
  g AS (SELECT v.doc, k, max(quote) FILTER (role = 'plain') AS plain, max(quote) FILTER (role = 'technical') AS technical, any_value(text) AS text FROM v JOIN st ON st.doc = v.doc AND status = 'ok' WHERE ok1 OR (q1 <> '' AND ok2) GROUP BY ALL HAVING count(*) = 2),
  d AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY doc, k) AS place FROM g)"""
_SLICE = r"regexp_extract({0}, replace(regexp_escape({1}), '\ ', '\s+'))"

ORACLE: dict[str, str] = {
    "rescued_pairs": f"""WITH {_RESCUE}, x AS (SELECT doc, k, {_SLICE.format('text', 'plain')} AS p, {_SLICE.format('text', 'technical')} AS c, text FROM d WHERE place = 1)
        SELECT doc, CAST(k AS INTEGER) AS item, md5(p) AS plain_md5, md5(c) AS technical_md5, CAST(strpos(text, p) - 1 AS INTEGER) AS start, CAST(strpos(text, p) - 1 + length(p) AS INTEGER) AS stop FROM x""",
    "rescue_manifest": f"""WITH {_RESCUE}, e AS (SELECT doc, count(*) FILTER (place = 1) AS pairs_emitted, count(*) FILTER (place > 1) AS pairs_dedup_skipped FROM d GROUP BY 1)
        SELECT doc, status, CASE WHEN status = 'budget_stop' OR doc % 11 = 0 THEN 0 ELSE 1 + retry_calls END AS calls, CASE WHEN status = 'budget_stop' THEN 0 ELSE retry_calls END AS retry_calls, CASE WHEN status = 'budget_stop' THEN 0 ELSE retry_saved END AS retry_saved,
          CASE WHEN status = 'budget_stop' THEN 0 ELSE attempts END AS attempts, CASE WHEN status = 'budget_stop' THEN 0 ELSE first_try_ok END AS first_try_ok, CASE WHEN status = 'budget_stop' THEN 0 ELSE attempts - first_try_ok - retry_saved END AS failures,
          coalesce(pairs_emitted, 0) AS pairs_emitted, coalesce(pairs_dedup_skipped, 0) AS pairs_dedup_skipped, CASE WHEN status = 'budget_stop' THEN 0 ELSE tin END AS tokens_in, CASE WHEN status = 'budget_stop' THEN 0 ELSE tout END AS tokens_out
        FROM st LEFT JOIN e USING (doc)""",
    "selected_spans": rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents),
        q AS (SELECT *, array_to_string(w[3:10], ' ') AS m1, array_to_string(w[13:17], ' ') AS m2, array_to_string(w[1:4], ' ') AS i FROM t),
        f AS (SELECT *, CASE WHEN length(m1) >= 8 THEN nullif({_SLICE.format('text', 'm1')}, '') END AS s1, CASE WHEN length(m2) >= 8 THEN nullif({_SLICE.format('text', 'm2')}, '') END AS s2, CASE WHEN length(i) >= 8 THEN nullif({_SLICE.format('text', 'i')}, '') END AS s3 FROM q),
        g AS (SELECT *, doc_id % 3 = 0 OR (s1 IS NULL AND s2 IS NULL) AS retried, CASE WHEN doc_id % 3 = 0 OR (s1 IS NULL AND s2 IS NULL) THEN CASE WHEN doc_id % 2 = 0 THEN s1 END ELSE s1 END AS a, CASE WHEN doc_id % 3 <> 0 THEN s2 END AS b FROM f),
        p AS (SELECT *, strpos(text, a) - 1 AS a0, strpos(text, a) - 1 + length(a) AS a1, strpos(text, b) - 1 AS b0, strpos(text, b) - 1 + length(b) AS b1 FROM g),
        o AS (SELECT *, CASE WHEN b IS NULL OR (a0, a1) <= (b0, b1) THEN a0 ELSE b0 END AS l0, CASE WHEN b IS NULL OR (a0, a1) <= (b0, b1) THEN a1 ELSE b1 END AS l1, CASE WHEN b IS NULL THEN NULL WHEN (a0, a1) <= (b0, b1) THEN b0 ELSE a0 END AS r0, CASE WHEN b IS NULL THEN NULL WHEN (a0, a1) <= (b0, b1) THEN b1 ELSE a1 END AS r1 FROM p WHERE a IS NOT NULL),
        m AS (SELECT doc_id, CASE WHEN r0 IS NULL OR (r0 = l0 AND r1 = l1) THEN l0 || '-' || l1 ELSE l0 || '-' || l1 || ',' || r0 || '-' || r1 END AS spans,
              CASE WHEN r0 IS NULL THEN substr(text, l0 + 1, l1 - l0) WHEN r0 <= l1 OR trim(substr(text, l1 + 1, r0 - l1), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN substr(text, l0 + 1, greatest(l1, r1) - l0) ELSE substr(text, l0 + 1, l1 - l0) || ' ' || substr(text, r0 + 1, r1 - r0) END AS passage FROM o),
        z AS (SELECT p.*, spans, passage, CASE WHEN passage IS NULL THEN 'no_mechanism_verified' WHEN p.doc_id % 5 = 0 THEN 'no_tech_section' ELSE 'ok' END AS status FROM p LEFT JOIN m USING (doc_id))
        SELECT doc_id, status, retried, 3 AS returned, CAST(s3 IS NOT NULL AS INTEGER) + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(s1 IS NOT NULL AS INTEGER) + CAST(s2 IS NOT NULL AS INTEGER) END AS verified, coalesce(spans, '') AS spans,
          CASE WHEN status = 'ok' THEN md5(passage) END AS passage_md5, CASE WHEN status = 'ok' THEN 'Technical details' END AS heading,
          CASE WHEN status = 'ok' THEN md5(trim('== Technical details ==' || chr(10) || right(text, 200) || chr(10) || '=== Operation ===' || chr(10) || left(text, 100), ' ')) END AS section_md5 FROM z""",
    "budget_in_order": "SELECT year(o_orderdate) AS year, count(*) FILTER (spent <= 100000000) AS n_paid, count(*) AS n, CAST(max(spent) AS BIGINT) AS spent FROM (SELECT o_orderdate, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) GROUP BY 1",
    "sanity_set": """WITH p AS (SELECT doc_id, source, quality, text, sha1('42:' || doc_id) AS h FROM documents JOIN labels USING (doc_id)), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS r FROM p) WHERE r <= 25),
        a AS (SELECT source, arg_min(text, h) AS ta FROM p GROUP BY 1), b AS (SELECT p.source, arg_min(text, h) AS tb FROM p JOIN a USING (source) WHERE text <> ta GROUP BY 1)
        SELECT CAST(doc_id AS VARCHAR) AS pair_id, 'aligned' AS gold, quality, md5(text) AS source_md5, md5(left(text, 60)) AS draft_md5 FROM s
        UNION ALL SELECT doc_id || '-NEG', 'unaligned', quality, md5(CASE WHEN ta = text THEN tb ELSE ta END), md5(left(text, 60)) FROM s JOIN a USING (source) JOIN b USING (source)""",
    "filled_blanks": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN '' ELSE lang END AS lang FROM documents",
}
