"""Queries of retrieval over indexes that are written once and read by many: BM25, its fusion with vectors, filtered vector search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import cells, lexicon, retrieve
from ..sources.checkpoints import shared_folder
from ..sources.rewrite import Files
from .pairs import table

Query = Callable[[SparkSession, str], DataFrame]


def document_index(spark: SparkSession, folder: str) -> lexicon.Lexicon:
    """The index of ``documents`` in the shared folder: made at the first call, and again when the table's files have changed."""
    path = f"{shared_folder(spark)}/lexicon-{hashlib.md5(folder.encode()).hexdigest()}"
    source = repr(Files(spark, folder).sizes(f"{folder}/documents.parquet"))
    return lexicon.current(spark, path, source) or lexicon.build(table(spark, folder, "documents"), "doc_id", "text", path, source=source)


def _bm25(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return lexicon.bm25(table(spark, folder, "benchmark"), "item_id", "text", document_index(spark, folder), k)


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each benchmark item by BM25, from the written index, with lists of common words pruned by their bounds."""
    return _bm25(spark, folder, 10)


def index_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What the index holds of the terms of the benchmark: in how many documents each is, how often, and in how many words they have in all."""
    index = document_index(spark, folder)
    wanted = retrieve.postings(table(spark, folder, "benchmark"), "item_id", F.col("text")).select("term").distinct()
    # Sums are made within a block: a posting does not become a row.
    total = lambda c: F.aggregate("postings", F.lit(0).cast("bigint"), lambda s, p: s + p[c])
    counts = index.blocks(wanted).select("term", total("tf").alias("n"), total("length").alias("n_words")).groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words"))
    return counts.join(index.terms(wanted).select("term", "df"), "term").select("term", "df", "n", "n_words")


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Of each benchmark item the documents of four sources: BM25 and vectors of letters, fused by rank; vectors alone where no document has a word of the item."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    profile = lambda rows, id: rows.select(F.col(id).alias("id"), models.letter_profile(F.col("text")).alias("vector"))
    dense = retrieve.top_k(profile(items, "item_id").withColumn("id", -1 - F.col("id")), profile(docs, "doc_id"), "id", "vector", 50).withColumn("query", -1 - F.col("query"))
    found = retrieve.hybrid(_bm25(spark, folder, 50).withColumnRenamed("doc", "match"), dense, docs.select(F.col("doc_id").alias("match"), "source"), "source")
    return found.select("query", "match", F.round("score", 6).alias("score"), "via", "rank")


def filter_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 nearest vectors of the query's own label; where there are fewer, also the 50 nearest of any."""
    vectors = table(spark, folder, "embeddings")
    built = cells.build(vectors, "vec_id", "embedding", "label", f"{shared_folder(spark)}/cells-{hashlib.md5(folder.encode()).hexdigest()}")
    return cells.ladder(vectors.where("vec_id % 100 = 0"), built, "vec_id", "embedding", "label", 50).select("query", "match", "rung", F.round("cosine", 4).alias("cosine"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (bm25_search, index_statistics, hybrid_search, filter_ladder)}

_TERMS = "unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS term"
_BM25 = f"""w AS (SELECT doc_id AS doc, {_TERMS} FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc, count(*) AS len FROM w GROUP BY 1),
  a AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents) AS avg), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  q AS (SELECT DISTINCT item_id AS query, {_TERMS} FROM benchmark),
  s AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term) JOIN l USING (doc), a GROUP BY ALL),
  text_leg AS (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s)"""
_PROFILE = "list_transform(['a','b','c','d','e','f','g','h','i','j','k','l','m','n','o','p','q','r','s','t','u','v','w','x','y','z'], lambda c: CAST(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), c, '')) AS DOUBLE))"
_UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"
_COSINES = f"""u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
  c AS (SELECT q.vec_id AS query, b.vec_id AS match, q.label AS a, b.label AS b, round(list_dot_product(q.v, b.v), 6) AS cosine FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)"""

ORACLE: dict[str, str] = {
    "bm25_search": f"WITH {_BM25} SELECT query, doc, score, rank FROM text_leg WHERE rank <= 10",
    "index_statistics": f"WITH {_BM25} SELECT term, df, CAST(sum(tf) AS BIGINT) AS n, CAST(sum(len) AS BIGINT) AS n_words FROM (SELECT DISTINCT term FROM q) JOIN df USING (term) JOIN p USING (term) JOIN l USING (doc) GROUP BY term, df",
    "hybrid_search": f"""WITH {_BM25}, dv AS (SELECT doc_id, source, {_UNIT} AS v FROM (SELECT doc_id, source, {_PROFILE} AS v FROM documents) WHERE list_sum(v) > 0), iv AS (SELECT item_id, {_UNIT} AS v FROM (SELECT item_id, {_PROFILE} AS v FROM benchmark) WHERE list_sum(v) > 0),
        d AS (SELECT item_id AS query, doc_id AS doc, round(list_dot_product(iv.v, dv.v), 6) AS cosine FROM iv, dv), dense_leg AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc) AS rank FROM d),
        f AS (SELECT query, doc, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM text_leg WHERE rank <= 50 UNION ALL SELECT query, doc, rank FROM dense_leg WHERE rank <= 50) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f), o AS (SELECT r.*, row_number() OVER (PARTITION BY query, source ORDER BY rank) AS k FROM r JOIN documents ON doc_id = doc WHERE rank <= 50),
        x AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS final FROM o WHERE k = 1)
        SELECT query, doc AS match, round(score, 6) AS score, CASE WHEN query IN (SELECT query FROM text_leg) THEN 'hybrid' ELSE 'dense' END AS via, final AS rank FROM x WHERE final <= 4""",
    "filter_ladder": f"""WITH {_COSINES}, strict AS (SELECT query, match, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match) AS r FROM c WHERE a = b) WHERE r <= 50),
        short AS (SELECT DISTINCT query FROM c WHERE query NOT IN (SELECT query FROM strict GROUP BY 1 HAVING count(*) >= 50)),
        loose AS (SELECT query, match, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match) AS r FROM c WHERE query IN (SELECT query FROM short)) WHERE r <= 50)
        SELECT query, match, 0 AS rung, round(cosine, 4) AS cosine FROM strict UNION ALL SELECT query, match, 1, round(cosine, 4) FROM loose l WHERE NOT EXISTS (SELECT 1 FROM strict s WHERE s.query = l.query AND s.match = l.match)""",
}
