"""Queries of assembly, dedup, retrieval and analytics over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import analytics, assemble, dedup, retrieve, sequences
from ..sources.checkpoints import stored
from .pairs import TALK_PAIRS_SQL, table, talk_pairs
from .search_queries import document_index

Query = Callable[[SparkSession, str], DataFrame]


def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different wording; copies are groups of their own, see ``near_dup_keep``."""
    return dedup.near_pairs(table(spark, folder, "documents"), "doc_id", F.col("text"))


def near_dup_keep(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup.near_classes(table(spark, folder, "documents"), "doc_id", F.col("text"))
    return found.select(F.col("id").alias("doc_id"), "keep")


def exact_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.sha2("text", 256).alias("sha"), F.col("doc_id").cast("string").alias("doc"))
    return analytics.sha_duplicates(docs, "sha", "doc").select("sha", "n", F.array_join("members", ",").alias("members"))


def content_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("cid", dedup.content_id(F.col("text"), F.col("lang")))
    return dedup.by_id(docs, "cid", [F.col("doc_id")]).select("cid", "doc_id")


def contamination_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold any eight words in a row of a benchmark item, but for white space: met by 64-bit hashes, and compared as texts where they meet."""
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text")
    hashed = lambda rows, id: rows.select(id, F.explode(F.array_distinct(F.transform(_grams(F.col("text")), lambda g: F.xxhash64(g)))).alias("g"))
    met = stored(hashed(docs, "doc_id").join(hashed(items, "item_id"), "g").select("doc_id", "item_id").distinct(), "met")
    both = met.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")
    return both.where(F.arrays_overlap(_grams(F.col("text")), _grams(F.col("item")))).select("doc_id", "item_id").distinct()


def _grams(text, width: int = 8):
    cut = lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))).otherwise(T.none_of())
    return T.let(T.matches(text, r"\S+"), cut)


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return table(spark, folder, "documents").select("doc_id", F.round(assemble.split_share(doc), 9).alias("share"), assemble.split_of(doc).alias("split"))


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return hash_split(spark, folder).groupBy("split").agg(F.count("*").alias("n"))


def ood_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    split = assemble.split_of(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.year("o_orderdate"), F.when(F.col("o_orderstatus") == "P", F.lit("test_ood_style")))
    return orders.groupBy(split.alias("split")).agg(F.count("*").alias("n"))


def distribution(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.distribution(table(spark, folder, "documents"), "source")


def facets(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.facets(table(spark, folder, "documents"), ["lang", "source"])


def topn_other(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.top_and_other(table(spark, folder, "documents"), "source", 10)


def year_stats(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.year_stats(table(spark, folder, "orders"), F.year("o_orderdate"))


def rollup_total(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.with_total(table(spark, folder, "events"), "event_type", F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.distinct_values(table(spark, folder, "documents"), "lang", "source")


def verdict_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two verdict files of the labels; the last one wins where both have a row."""
    labels = table(spark, folder, "labels")
    one = labels.select(F.col("doc_id").alias("pair_id"), F.when(F.col("quality") == 1, "aligned").otherwise("unaligned").alias("alignment_label"), F.lit(1).alias("file_order"))
    two = labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("pair_id"), F.when(F.col("toxic") == 1, "unaligned").otherwise("partial").alias("alignment_label"), F.lit(2).alias("file_order"))
    return assemble.last_verdicts(one.unionByName(two)).select("pair_id", "alignment_label")


def two_model_vote(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    a = labels.where("doc_id % 5 <> 0").select("doc_id", (F.col("quality") == 1).alias("positive"))
    b = labels.where("doc_id % 7 <> 0").select("doc_id", (F.col("toxic") == 0).alias("positive"))
    return analytics.two_model_vote(a, b, "doc_id")


def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "role", (F.length("text") % 7 / 7.0).alias("confidence"))
    return analytics.majority_vote(turns, "conv_id", "role", "confidence")


def publication_gate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.when(F.col("text").rlike("Apache License"), "apache-2.0").when(F.col("text").rlike("CC BY-NC"), "cc-by-nc-4.0").alias("license"), (~T.has_email(F.col("text"))).alias("pii_scrubbed"))
    gated = assemble.publication_gate(docs, ("apache-2.0",))
    return gated.select("doc_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))


def drop_accounting(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("pair_id"), F.col("source").alias("tag"), F.when(F.col("doc_id") % 4 == 0, "doc_level").otherwise("prose").alias("exec_span_kind"), (F.col("doc_id") % 2 == 0).alias("needs_llm_verify"), F.lit("").alias("notes"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("pair_id"), F.when(F.col("quality") == 1, "aligned").otherwise("unaligned").alias("alignment_label"), F.lit(0.9).alias("alignment_confidence"))
    near = docs.where("pair_id % 11 = 0").select("pair_id")
    return analytics.drop_accounting(assemble.gate(docs, labels, near, ["tag"]), "tag")


def group_synthesis(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    sev = F.element_at(F.array(*map(F.lit, ("Low", "Info", "High", "Critical", "Medium"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("string").alias("pair_id"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("technical_context"), sev.alias("severity_original"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("technical_text"), F.array(F.col("l_partkey").cast("string")).alias("numeric_facts"))
    out = assemble.group_pairs(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "n_members", "first_id", "severity_original", F.array_join("numeric_facts", ",").alias("facts"), F.md5("technical_text").alias("text_md5"))


def nearest_lower_host(spark: SparkSession, folder: str) -> DataFrame:
    """For events that are not purchases, the user's last purchase before, within a day."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("at"))
    found = sequences.nearest_lower(events, "user_id", F.col("at"), F.col("event_type") == "purchase", "event_id", 86_400)
    return found.where("event_type <> 'purchase'").select("event_id", "host", "gap")


def citation_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of line numbers cited by an order's lines, joined to the lines they cite."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("num"))
    cites = lines.where("num >= 3").select("doc", F.col("num").alias("citing"), F.array(F.struct(F.lit(1).alias("a"), (F.col("num") - 1).alias("b"))).alias("ranges"))
    return sequences.range_join(cites, lines)


def run_length(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber") + F.col("l_partkey") % 3)).alias("n"))
    return lines.select("l_orderkey", F.array_join(T.run_lengths(F.col("n")), ",").alias("runs"))


def gap_sequence(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 9).alias("v")))), lambda x: x["v"]).alias("n"))
    return parts.select("l_orderkey", F.array_join(T.gap_accepted(F.col("n"), 3).cast("array<string>"), ",").alias("accepted"))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieve.postings(table(spark, folder, "documents"), "doc_id", F.col("text"))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))


def posting_deltas(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieve.postings(table(spark, folder, "benchmark"), "item_id", F.col("text")).groupBy("term").agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    steps = index.withColumn("steps", T.deltas(F.col("docs")))
    return steps.select("term", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"), (T.undeltas(F.col("steps")) == F.col("docs")).alias("round_trip"))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    items, index = table(spark, folder, "benchmark"), document_index(spark, folder)
    terms = stored(retrieve.query_terms(items, "item_id", F.col("text"), index, index.n_docs), "terms")
    hits = retrieve.lexical_scores(terms, index).where(retrieve.qualifies())
    order = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    return hits.withColumn("score", F.round("lexical", 5)).withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("query", "doc", "score", "rank")


def finding_search(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    found = retrieve.search(items, table(spark, folder, "documents"), "item_id", "text", "doc_id", "text", limit=3, index=document_index(spark, folder))
    return found.select("query", "doc", "score", "exact", F.size("signals").cast("bigint").alias("n_signals"), "rank")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return retrieve.top_k(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 4))


def cosine_argmax_excl_group(spark: SparkSession, folder: str) -> DataFrame:
    """For every vector the nearest one of another label."""
    vectors = table(spark, folder, "embeddings")
    return retrieve.top_k(vectors, vectors, "vec_id", "embedding", 1, exclude_same="label").select("query", "match", (F.round(F.col("cosine") * 10_000) / 10_000).alias("cosine"))  # a half in decimals, 0.38835, is rounded as in the SQL


def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """For every vector its nearest ones, of any label and of others, fused by rank; both lists come from one scoring of all pairs."""
    vectors = table(spark, folder, "embeddings")
    lists = retrieve.top_lists(vectors, vectors, "vec_id", "embedding", [(10, False), (10, True)], "label")
    return retrieve.fused([lists], pool=10).withColumn("score", F.round("score", 6))


def training_mix_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.element_at(F.array(F.lit("T1"), F.lit("T2"), F.lit("T3")), (F.col("doc_id") % 3 + 1).cast("int")).alias("tier"), "lang", T.token_estimate(F.col("text")).alias("tokens"))
    out = analytics.mix_weights(docs, "tier", "lang", "tokens", {"T1": 0.6, "T2": 0.25, "T3": 0.15})
    return out.groupBy("tier", "lang").agg(F.count("*").alias("n"), F.round(F.max("weight"), 4).alias("weight"))


def paragraph_cap(spark: SparkSession, folder: str) -> DataFrame:
    text = assemble.first_paragraphs(F.regexp_replace("text", "\n", "\n\n"), 60)
    return table(spark, folder, "documents").select("doc_id", F.size(T.matches(text, r"\S+")).cast("bigint").alias("n_words"), F.md5(text).alias("text_md5"))


def rule_adherence(spark: SparkSession, folder: str) -> DataFrame:
    s, d = F.col("source_text"), F.col("draft_text")
    rules = {"shorter": (F.length(s) > 100, F.length(d) <= F.length(s)), "capital": (F.length(d) > 0, d.rlike("^[A-Z]")), "stop": (F.length(d) > 0, d.rlike(r"[.!?]$"))}
    return analytics.rule_adherence(talk_pairs(spark, folder), rules, F.concat_ws("/", "conv_id", "turn"))


def compression_median(spark: SparkSession, folder: str) -> DataFrame:
    pairs = talk_pairs(spark, folder).select(F.when(F.length("source_text") < 200, "short").when(F.length("source_text") < 600, "middle").otherwise("long").alias("band"), (T.word_count(F.col("draft_text")) / F.greatest(T.word_count(F.col("source_text")), F.lit(1))).alias("ratio"))
    return pairs.groupBy("band").agg(F.count("*").alias("n"), F.round(F.percentile("ratio", F.lit(0.5)), 6).alias("median_ratio"))


def duplicate_rate(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.duplicate_rate(table(spark, folder, "documents"), "text")


def group_composition(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("group", F.sha2("text", 256))
    return analytics.group_composition(docs, "group", "lang")


def budget_stop(spark: SparkSession, folder: str) -> DataFrame:
    paid = analytics.within_budget(table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("cost")), [F.col("o_orderkey")], "cost", 500_000, ["o_custkey"])
    return paid.groupBy("o_custkey").agg(F.count_if("paid").alias("n_paid"), F.count("*").alias("n"), F.max("spent").alias("spent"))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.size(F.array_distinct(T.matches(F.lower("text"), "[a-z]+"))).alias("d"), F.size(T.matches(F.col("text"), "[a-zA-Z]+")).alias("n")).join(table(spark, folder, "labels"), "doc_id")
    scored = rows.select((F.col("d") / F.greatest("n", F.lit(1))).alias("score"), (F.col("quality") == 0).alias("bad"))
    return analytics.threshold_sweep(scored, "score", "bad", [0.1, 0.3, 0.5, 0.7])


def html_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").select("page_id", F.explode(sequences.html_headings(F.col("html"))).alias("h"))
    return rows.select("page_id", "h.level", "h.title")


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    text = sequences.html_text(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


def html_index(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", sequences.html_title(F.col("html")).alias("title"), F.size(sequences.html_headings(F.col("html"))).cast("bigint").alias("n_headings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    near_dup_pairs, near_dup_keep, exact_dup_groups, content_hash_dedup, contamination_hits, hash_split, split_counts, ood_split, distribution, facets, topn_other, year_stats,
    rollup_total, distinct_values, verdict_merge, two_model_vote, majority_vote, publication_gate, drop_accounting, group_synthesis, nearest_lower_host, citation_range_join, run_length,
    gap_sequence, postings, posting_deltas, lexical_search, finding_search, cosine_topk, cosine_argmax_excl_group, rank_fusion, training_mix_weights, paragraph_cap, rule_adherence, compression_median,
    duplicate_rate, group_composition, budget_stop, threshold_sweep, html_sections, html_to_text, html_index,
)}

_SHARE = "CAST('0x' || substr(sha1('20260707:' || CAST({0} AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0"
_SPLIT = f"CASE WHEN {_SHARE} < 0.8 THEN 'train' WHEN {_SHARE} < 0.9 THEN 'val' ELSE 'test' END"
_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings"
_COS = f"u AS ({_UNIT}), c AS (SELECT q.vec_id AS query, b.vec_id AS match, round(list_dot_product(q.v, b.v), 6) AS cosine, q.label AS ql, b.label AS bl FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)"
_ALL_COS = f"u AS ({_UNIT}), c AS (SELECT q.vec_id AS query, b.vec_id AS match, round(list_dot_product(q.v, b.v), 6) AS cosine, q.label AS ql, b.label AS bl FROM u q JOIN u b ON q.vec_id <> b.vec_id)"
_SHINGLE_SQL = """s AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS w FROM documents),
  g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE [array_to_string(w, ' ')] END AS g FROM s),
  e AS (SELECT doc_id, unnest(g) AS x FROM g), n AS (SELECT doc_id, len(g) AS n FROM g),
  i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
  j AS (SELECT a, b, round(k / (na.n + nb.n - k), 6) AS similarity FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k / (na.n + nb.n - k) >= 0.85)"""
_GATED = """d AS (SELECT doc_id, source AS tag, doc_id % 4 = 0 AS doclevel, doc_id % 2 = 0 AS needs FROM documents),
  v AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'aligned' ELSE 'unaligned' END AS label FROM labels)"""
_TEXT8 = "list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i : i + 7], ' '))"

#: Shares of each query's idf that the documents have; the tables hold no identifiers, so wording alone qualifies.
_LEXICAL = """WITH p AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS term FROM documents), l AS (SELECT doc, count(*) AS len FROM p GROUP BY 1), a AS (SELECT avg(len) AS avg FROM l),
        df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT item_id AS query, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT query, term, ln(1 + (SELECT count(*) FROM documents) / df) AS idf, tf FROM q JOIN df USING (term)), k AS (SELECT query, term, idf FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY idf DESC, tf DESC, term) AS r FROM s) WHERE r <= 40),
        m AS (SELECT query, sum(idf) AS mass, count(*) AS nt FROM k GROUP BY 1), h AS (SELECT query, doc, sum(idf) AS got, count(*) AS hits FROM p JOIN k USING (term) GROUP BY ALL),
        o AS (SELECT query, doc, round(got / mass / (0.7 + 0.3 * len / avg), 9) AS x, hits, nt FROM h JOIN m USING (query) JOIN l USING (doc), a)"""
_BAND = r"CASE WHEN regexp_matches(text, '(?i)\bcritical\b|\bactively exploited\b|exploitation observed') THEN 4 WHEN regexp_matches(text, '(?i)\bhigh\b') THEN 3 WHEN regexp_matches(text, '(?i)\bmedium\b|\bmoderate\b') THEN 2 WHEN regexp_matches(text, '(?i)\blow\b') THEN 1 WHEN regexp_matches(text, '(?i)\binformational\b|\binfo\b') THEN 0 END"
_TOPIC_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in retrieve.TOPIC_WORDS) + "], lambda x: x IS NOT NULL)"
_FACTS = ", ".join(f"{name} AS (SELECT {id} AS id, {_BAND} AS band, {_TOPIC_LIST} AS topics FROM {source})" for name, id, source in (("qfacts", "item_id", "benchmark"), ("dfacts", "doc_id", "documents")))

ORACLE: dict[str, str] = {
    "near_dup_pairs": f"WITH {_SHINGLE_SQL}, h AS (SELECT doc_id, md5(array_to_string(list_sort(g), chr(10))) AS h FROM g), r AS (SELECT min(doc_id) AS doc_id FROM h GROUP BY h) SELECT a, b, similarity FROM j WHERE a IN (SELECT doc_id FROM r) AND b IN (SELECT doc_id FROM r)",
    "near_dup_keep": f"WITH RECURSIVE {_SHINGLE_SQL}, l AS (SELECT a AS x, b AS y FROM j UNION ALL SELECT b, a FROM j), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y) SELECT x AS doc_id, min(y) AS keep FROM reach GROUP BY x",
    "exact_dup_groups": "SELECT sha256(text) AS sha, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS members FROM documents GROUP BY 1 HAVING count(*) > 1",
    "content_hash_dedup": "SELECT substr(md5(text || lang), 1, 10) AS cid, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "contamination_hits": rf"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), d AS (SELECT DISTINCT doc_id, unnest({_TEXT8}) AS g FROM w WHERE len(w) >= 8), b AS (SELECT item_id, unnest({_TEXT8}) AS g FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark) WHERE len(w) >= 8) SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (g)",
    "hash_split": f"SELECT doc_id, round({_SHARE.format('doc_id')}, 9) AS share, {_SPLIT.format('doc_id')} AS split FROM documents",
    "split_counts": f"SELECT {_SPLIT.format('doc_id')} AS split, count(*) AS n FROM documents GROUP BY 1",
    "ood_split": f"SELECT CASE WHEN o_orderstatus = 'P' THEN 'test_ood_style' WHEN year(o_orderdate) >= 2026 THEN 'test_ood_temporal' ELSE {_SPLIT.format('o_orderkey')} END AS split, count(*) AS n FROM orders GROUP BY 1",
    "distribution": "SELECT coalesce(nullif(trim(source), ''), '(none)') AS value, count(*) AS n FROM documents GROUP BY 1",
    "facets": "SELECT 'lang' AS facet, coalesce(nullif(trim(lang), ''), '(none)') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(nullif(trim(source), ''), '(none)'), count(*) FROM documents GROUP BY 2",
    "topn_other": "WITH d AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS r FROM d) SELECT CASE WHEN r <= 10 THEN value ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "year_stats": "SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, count(o_orderdate) AS known, count(*) - count(o_orderdate) AS unknown FROM orders",
    "rollup_total": "WITH e AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT event_type, n, users FROM e UNION ALL SELECT 'ALL', CAST(sum(n) AS BIGINT), CAST(sum(users) AS BIGINT) FROM e",
    "distinct_values": "SELECT count(DISTINCT lang) + CAST(count(lang) < count(*) AS INTEGER) AS n_lang, count(DISTINCT source) + CAST(count(source) < count(*) AS INTEGER) AS n_source FROM documents",
    "verdict_merge": "SELECT doc_id AS pair_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN toxic = 1 THEN 'unaligned' ELSE 'partial' END WHEN quality = 1 THEN 'aligned' ELSE 'unaligned' END AS alignment_label FROM labels",
    "two_model_vote": "WITH a AS (SELECT doc_id, quality = 1 AS p FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, toxic = 0 AS p FROM labels WHERE doc_id % 7 <> 0) SELECT doc_id, CASE WHEN a.p AND b.p THEN 'aligned' WHEN a.p <> b.p THEN 'partial' WHEN NOT a.p AND NOT b.p THEN 'unaligned' END AS label, a.p <> b.p AS disagree FROM a FULL JOIN b USING (doc_id)",
    "majority_vote": "WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), m AS (SELECT conv_id, arg_min(role, (-n, role)) AS label, count(*) = 1 AS agree FROM c GROUP BY 1) SELECT conv_id, label, round(avg(length(text) % 7 / 7.0), 3) AS confidence, count(*) AS passes, any_value(agree) AS agree FROM conversations JOIN m USING (conv_id) GROUP BY conv_id, label",
    "publication_gate": "SELECT doc_id, CASE WHEN l IS NULL THEN 'licence_unknown' WHEN l <> 'apache-2.0' THEN 'licence_closed' WHEN mail THEN 'pii' ELSE 'kept' END AS reason FROM (SELECT doc_id, CASE WHEN contains(text, 'Apache License') THEN 'apache-2.0' WHEN contains(text, 'CC BY-NC') THEN 'cc-by-nc-4.0' END AS l, regexp_matches(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+[.][\\p{L}\\p{N}_.]+') AS mail FROM documents)",
    "drop_accounting": f"WITH {_GATED} SELECT tag, CASE WHEN doc_id % 11 = 0 THEN 'near_duplicate' WHEN NOT doclevel AND needs AND label IS NULL THEN 'unverified_pending' WHEN NOT doclevel AND label = 'unaligned' THEN 'verifier_unaligned' ELSE 'kept' END AS reason, count(*) AS n FROM d LEFT JOIN v USING (doc_id) GROUP BY ALL",
    "group_synthesis": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS VARCHAR) AS pair_id, CAST(l_partkey AS VARCHAR) AS p, ['Low','Info','High','Critical','Medium'][l_partkey % 5 + 1] AS sev, [4,2,6,7,5][l_partkey % 5 + 1] AS rank FROM lineitem)
        SELECT l_orderkey, count(*) AS n_members, arg_min(pair_id, l_linenumber) AS first_id, arg_max(sev, rank) AS severity_original, array_to_string(list_sort(list_distinct(list(p)))[1:40], ',') AS facts,
               md5(left(string_agg('[item ' || p || '] (severity: ' || sev || ')' || chr(10) || 'part ' || p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey), 14000)) AS text_md5 FROM x GROUP BY l_orderkey HAVING count(*) > 1""",
    "nearest_lower_host": "WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events), w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER o AS h, last_value(CASE WHEN event_type = 'purchase' THEN at_s END IGNORE NULLS) OVER o AS ha FROM e WINDOW o AS (PARTITION BY user_id ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, CASE WHEN at_s - ha <= 86400 THEN h END AS host, CASE WHEN at_s - ha <= 86400 THEN at_s - ha END AS gap FROM w WHERE event_type <> 'purchase'",
    "citation_range_join": "SELECT c.l_orderkey AS doc, c.l_linenumber AS citing, string_agg(CAST(t.l_linenumber AS VARCHAR), ',' ORDER BY t.l_linenumber) AS cited FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) c JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) t ON t.l_orderkey = c.l_orderkey AND t.l_linenumber BETWEEN 1 AND c.l_linenumber - 1 WHERE c.l_linenumber >= 3 GROUP BY ALL",
    "run_length": "WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber + l_partkey % 3 AS n FROM lineitem), g AS (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM x), r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_orderkey, g) SELECT l_orderkey, string_agg(CASE WHEN a = b THEN 'P' || a ELSE 'P' || a || '-P' || b END, ',' ORDER BY a) AS runs FROM r GROUP BY 1",
    "gap_sequence": """WITH RECURSIVE x AS (SELECT l_orderkey, l_partkey % 9 AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 9) AS i FROM lineitem),
        s AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS last, '' AS accepted FROM (SELECT DISTINCT l_orderkey FROM x) UNION ALL
        SELECT s.l_orderkey, x.i, CASE WHEN x.v > last AND x.v <= last + 3 THEN x.v ELSE last END, CASE WHEN x.v > last AND x.v <= last + 3 THEN accepted || CASE WHEN accepted = '' THEN '' ELSE ',' END || x.v ELSE accepted END FROM s JOIN x ON x.l_orderkey = s.l_orderkey AND x.i = s.i + 1)
        SELECT l_orderkey, arg_max(accepted, i) AS accepted FROM s GROUP BY 1""",
    "postings": "SELECT term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS term FROM documents) GROUP BY 1",
    "posting_deltas": "WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS term FROM benchmark) SELECT term, string_agg(CAST(step AS VARCHAR), ',' ORDER BY item_id) AS steps, true AS round_trip FROM (SELECT term, item_id, item_id - coalesce(lag(item_id) OVER (PARTITION BY term ORDER BY item_id), 0) AS step FROM t) GROUP BY 1",
    "lexical_search": f"""{_LEXICAL}, z AS (SELECT query, doc, round(x, 5) AS score FROM o WHERE x >= 0.1 AND hits >= CASE WHEN nt < 3 THEN 1 ELSE 2 END)
        SELECT query, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM z) WHERE rank <= 5""",
    "finding_search": f"""{_LEXICAL}, {_FACTS}, z AS (SELECT o.query, o.doc, x + CASE WHEN qf.band = df.band THEN 0.05 ELSE 0 END + CASE WHEN list_has_any(qf.topics, df.topics) THEN 0.1 ELSE 0 END AS base, CAST(coalesce(qf.band = df.band, false) AS INTEGER) + len(list_intersect(qf.topics, df.topics)) AS signs
          FROM o JOIN qfacts qf ON qf.id = o.query JOIN dfacts df ON df.id = o.doc WHERE x >= 0.1 AND hits >= CASE WHEN nt < 3 THEN 1 ELSE 2 END),
        short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY base DESC, doc) AS r FROM z) WHERE r <= 50), kept AS (SELECT query, list(term) AS kept FROM k GROUP BY 1),
        seq AS (SELECT item_id AS query, regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}') AS s FROM benchmark),
        ph AS (SELECT query, list_distinct(list_transform(list_filter(range(1, len(s)), lambda i: list_contains(kept, s[i]) AND list_contains(kept, s[i + 1])), lambda i: s[i] || ' ' || s[i + 1])) AS p FROM seq JOIN kept USING (query)),
        f AS (SELECT short.*, len(list_filter(p, lambda x: contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || x || ' '))) AS found FROM short JOIN ph USING (query) JOIN documents ON doc_id = doc)
        SELECT query, doc, round(total, 3) AS score, false AS exact, signs + found AS n_signals, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY total DESC, doc) AS INTEGER) AS rank FROM (SELECT *, base + least(found * 0.12, 0.5) AS total FROM f)) WHERE rank <= 3""",
    "cosine_topk": f"WITH {_COS} SELECT query, match, round(cosine, 4) AS cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match) AS INTEGER) AS rank FROM c) WHERE rank <= 5",
    "cosine_argmax_excl_group": f"WITH {_ALL_COS} SELECT query, match, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match) AS r FROM c WHERE ql <> bl) WHERE r = 1",
    "rank_fusion": f"WITH {_ALL_COS}, a AS (SELECT query, match, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match) AS rank FROM c) WHERE rank <= 10), b AS (SELECT query, match, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match) AS rank FROM c WHERE ql <> bl) WHERE rank <= 10), f AS (SELECT query, match, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT query, match, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, match) AS INTEGER) AS rank FROM f) WHERE rank <= 10",
    "training_mix_weights": r"""WITH RECURSIVE d AS (SELECT 'T' || (doc_id % 3 + 1) AS tier, lang, greatest(1, CAST(round_even(len(regexp_extract_all(text, '\S+')) * 1.3, 0) AS INTEGER)) AS tokens FROM documents),
        p AS (SELECT tier, lang, sum(tokens) AS t, count(*) AS c FROM d GROUP BY ALL), q AS (SELECT *, t / sum(t) OVER (PARTITION BY tier) AS raw, greatest(0.45, 1 / count(*) OVER (PARTITION BY tier)) AS most FROM p),
        f AS (SELECT tier, lang, t, c, raw, most, raw AS part, false AS fixed, 0 AS i FROM q UNION ALL SELECT tier, lang, t, c, raw, most, CASE WHEN fx THEN most WHEN sum(CASE WHEN fx THEN 0 ELSE raw END) OVER (PARTITION BY tier) > 0 THEN raw / sum(CASE WHEN fx THEN 0 ELSE raw END) OVER (PARTITION BY tier) * (1 - sum(CASE WHEN fx THEN most ELSE 0 END) OVER (PARTITION BY tier)) ELSE 0 END, fx, i + 1 FROM (SELECT *, fixed OR part > most + 1e-12 AS fx FROM f WHERE i < 12)),
        w AS (SELECT tier, lang, c, part * CASE tier WHEN 'T1' THEN 0.6 WHEN 'T2' THEN 0.25 ELSE 0.15 END / t AS w FROM f WHERE i = 12)
        SELECT tier, lang, c AS n, round(round(w / (SELECT sum(w * c) / sum(c) FROM w), 6), 4) AS weight FROM w""",
    "paragraph_cap": r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS p FROM documents),
        s AS (SELECT doc_id, 0 AS i, 0 AS n, '' AS kept, true AS open FROM p UNION ALL SELECT s.doc_id, i + 1, CASE WHEN ok THEN n + w ELSE n END, CASE WHEN ok THEN kept || CASE WHEN kept = '' THEN '' ELSE chr(10) || chr(10) END || part ELSE kept END, ok
        FROM (SELECT s.*, p.p[s.i + 1] AS part, len(regexp_extract_all(p.p[s.i + 1], '\S+')) AS w, open AND (kept = '' OR n + len(regexp_extract_all(p.p[s.i + 1], '\S+')) <= 60) AS ok FROM s JOIN p USING (doc_id) WHERE s.i < len(p.p) AND s.open) s)
        SELECT doc_id, len(regexp_extract_all(kept, '\S+')) AS n_words, md5(kept) AS text_md5 FROM (SELECT doc_id, arg_max(kept, i) AS kept FROM s GROUP BY 1)""",
    "rule_adherence": f"""WITH {TALK_PAIRS_SQL}, r AS (SELECT 'shorter' AS rule, length(source_text) > 100 AS a, length(draft_text) <= length(source_text) AS f, conv_id || '/' || turn AS e FROM talk_pairs
        UNION ALL SELECT 'capital', length(draft_text) > 0, regexp_matches(draft_text, '^[A-Z]'), conv_id || '/' || turn FROM talk_pairs UNION ALL SELECT 'stop', length(draft_text) > 0, regexp_matches(draft_text, '[.!?]$'), conv_id || '/' || turn FROM talk_pairs)
        SELECT rule, count(*) AS applicable, count(*) FILTER (f) AS followed, min(e) FILTER (f) AS example, round(count(*) FILTER (f) / count(*), 6) AS rate, CASE WHEN round(count(*) FILTER (f) / count(*), 6) >= 0.7 THEN 'strong' WHEN round(count(*) FILTER (f) / count(*), 6) >= 0.5 THEN 'mixed' ELSE 'weak' END AS verdict FROM r WHERE a GROUP BY rule""",
    "compression_median": rf"WITH {TALK_PAIRS_SQL} SELECT CASE WHEN length(source_text) < 200 THEN 'short' WHEN length(source_text) < 600 THEN 'middle' ELSE 'long' END AS band, count(*) AS n, round(quantile_cont(len(regexp_extract_all(draft_text, '\S+')) / greatest(len(regexp_extract_all(source_text, '\S+')), 1), 0.5), 6) AS median_ratio FROM talk_pairs GROUP BY 1",
    "duplicate_rate": "SELECT CAST(sum(n) AS BIGINT) AS n_rows, coalesce(CAST(sum(n) FILTER (n > 1) AS BIGINT), 0) AS n_duplicated, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS rate FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)",
    "group_composition": "SELECT kinds, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT text, string_agg(DISTINCT lang, '+' ORDER BY lang) AS kinds, count(*) AS n FROM documents GROUP BY 1) GROUP BY 1",
    "budget_stop": "SELECT o_custkey, count(*) FILTER (spent <= 500000) AS n_paid, count(*) AS n, CAST(max(spent) AS BIGINT) AS spent FROM (SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) GROUP BY 1",
    "threshold_sweep": """WITH d AS (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) / greatest(len(regexp_extract_all(text, '[a-zA-Z]+')), 1) AS score FROM documents), x AS (SELECT score, quality = 0 AS bad, unnest([0.1, 0.3, 0.5, 0.7]) AS threshold FROM d JOIN labels USING (doc_id)),
        r AS (SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CAST(score < threshold AS INTEGER)) FILTER (bad), 6) AS recall, round(avg(CAST(score < threshold AS INTEGER)) FILTER (NOT bad), 6) AS false_rate FROM x GROUP BY 1)
        SELECT *, coalesce(threshold = (SELECT threshold FROM r WHERE false_rate <= 0.1 ORDER BY recall DESC, threshold LIMIT 1), false) AS best FROM r""",
    "html_sections": r"SELECT page_id, CAST(substr(h, 3, 1) AS INTEGER) AS level, trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS h FROM pages)",
    "html_index": r"SELECT page_id, trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS n_headings FROM pages",
    "html_to_text": r"WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a) SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM b".replace('\\"', '"'),
}
