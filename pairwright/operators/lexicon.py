"""A lexical index that outlives a query: postings in blocks with bounds, in folders by term, with a catalogue of statistics; and BM25 over it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import index_terms
from ..sources.checkpoints import stored
from ..sources.rewrite import Files

#: Fixed values of the score: how fast term frequency saturates, and how much length counts.
K1, B = 1.2, 0.75
#: Documents of a shard, which bounds what a block of one term can hold.
SHARD_DOCS = 4096
#: Shards that a task makes the blocks of, where there are more shards than cores.
TASK_SHARDS = 8
#: Terms of queries are sent to all tasks up to this number, and joined by a shuffle beyond.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class Lexicon:
    """An index as published: where it lies, and its catalogue."""

    spark: SparkSession
    path: str
    buckets: int
    shards: int
    n_docs: int
    n_filled: int
    n_tokens: int
    n_distinct: int
    doc: str
    stopwords: tuple[str, ...] = ()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _asked(self, table: str, wanted: DataFrame) -> DataFrame:
        """Rows of ``table`` whose term is in ``wanted(term)``; only the folders of those terms are listed and read."""
        keys = wanted.select("term").distinct().withColumn("bucket", self._bucket())
        asked = sorted(r[0] for r in keys.select("bucket").distinct().collect())  # as many as there are folders, at most
        rows = self.spark.read.schema(_schema(self.doc)[table]).parquet(f"{self.path}/{table}").where(F.col("bucket").isin(asked) if asked else F.lit(False))
        return rows.join(_small(keys), ["term", "bucket"], "left_semi").drop("bucket")

    def terms(self, wanted: DataFrame) -> DataFrame:
        """(``term``, ``df``, ``bound``): in how many documents a term is, and the most it can add to a score but for its idf."""
        return self._asked("terms", wanted)

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """(``term``, ``shard``, ``bound``, ``n``, ``postings``), postings being an array of ``doc``, ``tf``, ``length``, ``distinct`` in order of documents, and ``n`` how many."""
        return self._asked("postings", wanted)

    def postings(self, wanted: DataFrame) -> DataFrame:
        """(``term``, ``doc``, ``tf``, ``length``, ``distinct``), a row per posting."""
        return self.blocks(wanted).select("term", F.explode("postings").alias("p")).select("term", "p.*")


def _schema(doc: str) -> dict[str, str]:
    """The columns of both tables, for ids of the given type."""
    return {"terms": "term string, df bigint, bound double, bucket int", "postings": f"term string, shard int, bound double, n int, postings array<struct<doc: {doc}, tf: int, length: int, distinct: int>>, bucket int"}


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows


def by_shard(index: Lexicon, terms: DataFrame, prune: Column | None = None) -> DataFrame:
    """``terms`` with the blocks of each that pass ``prune``; all blocks of a shard are in one task, of which there are as many as shards.

    Sums by shard, query and document need no shuffle then, and a task's are bounded by the queries times the documents of a few shards, however many there are.
    """
    blocks = index.blocks(terms).repartition(index.shards, "shard").join(_small(terms), "term")
    return blocks if prune is None else blocks.where(prune)


def build(docs: DataFrame, id: str, text: str, path: str, stopwords: tuple[str, ...] = (), buckets: int | None = None, shard_docs: int = SHARD_DOCS, source: str = "") -> Lexicon:
    """Write an index of ``docs`` under ``path`` and make it the current one there, whole; readers of the one before are not disturbed.

    Postings are grouped by term and shard of documents, so that the list of a word which all documents have is as many
    blocks as there are shards and never one row. Only the texts are shuffled, once, by shard: a task makes the blocks of a shard after
    the other and writes them into folders by a hash of the term (8 to 64 of them), so the disk it takes is that of the texts and of the
    index, and files keep their size when the table grows. Rows that share an id are scored as one document; null texts have no terms.
    """
    spark = docs.sparkSession
    counts = docs.select(F.col(id).alias("doc"), F.size(index_terms(F.col(text), stopwords)).alias("length")).groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.greatest("length", F.lit(0))).alias("length"))
    n_docs, n_filled, n_tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("length") > 0), F.sum("length")).first()
    average = (n_tokens or 0) / max(n_docs, 1) or 1.0
    shards = -(-n_docs // shard_docs) or 1
    buckets = buckets or min(64, max(8, shards // TASK_SHARDS))
    tasks = min(shards, max(-(-shards // TASK_SHARDS), spark.sparkContext.defaultParallelism))
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.pmod(F.xxhash64(id), F.lit(shards)).cast("int").alias("shard"), F.col(id).alias("doc"), F.lower(F.col(text)).alias("t")).where("t is not null")
    dealt = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard")
    blocks = dealt.mapInArrow(_inverted(average, stopwords), f"term string, shard int, bound double, n int, doc array<{kind}>, tf array<int>, length array<int>, distinct array<int>")
    version = f"v-{uuid.uuid4().hex}"
    at = f"{path}/{version}"
    # Numbers side by side take less room while they are sorted than a struct for each posting.
    ordered = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).sortWithinPartitions("bucket", "term", "shard")
    zipped = ordered.select("term", "shard", "bound", "n", F.arrays_zip("doc", "tf", "length", "distinct").alias("postings"), "bucket")
    zipped.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/postings")
    written = spark.read.schema(_schema(kind)["postings"]).parquet(f"{at}/postings")
    n_distinct = written.agg(F.sum("n")).first()[0]
    terms = written.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("bound").alias("bound"))
    terms.repartition(F.col("bucket")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
    files = Files(spark, path)
    files.mark(f"{at}/catalogue.json", json.dumps({"buckets": buckets, "shards": shards, "n_docs": n_docs, "n_filled": n_filled, "n_tokens": n_tokens or 0, "n_distinct": n_distinct or 0, "doc": kind, "stopwords": list(stopwords), "source": source}))
    files.mark(f"{path}/CURRENT", version)
    return current(spark, path)


def _inverted(average: float, stopwords: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (``shard``, ``doc``, lower-case text) in order of shards, the blocks of one shard after the other: arrays of equal length, in order of documents, a document being all rows that share an id."""
    find, left_out = re.compile("[a-z][a-z0-9]{2,}").findall, frozenset(stopwords)

    def blocks(shard: int, ids: list[pa.Array], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays(ids).dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        docs, place = coded.dictionary.take(pa.array(order)), np.argsort(order)
        doc, words, counts = place[coded.indices.to_numpy()], [], []
        for text in texts:
            for t in text.to_pylist():
                found = find(t)
                if left_out:
                    found = [w for w in found if w not in left_out]
                words += found
                counts.append(len(found))
        if not words:
            return
        tokens = pa.array(words, pa.string()).dictionary_encode()
        keys, tf = np.unique(tokens.indices.to_numpy().astype(np.int64) * len(docs) + np.repeat(doc, counts), return_counts=True)
        term, own = np.divmod(keys, len(docs))
        length, distinct = np.bincount(doc, weights=counts, minlength=len(docs)).astype(np.int32), np.bincount(own, minlength=len(docs)).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        ends = np.r_[starts, len(keys)].astype(np.int32)
        most = np.maximum.reduceat(saturation(tf, length[own], average), starts)
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (docs.take(pa.array(own)), *(pa.array(x, pa.int32()) for x in (tf, length[own], distinct[own])))]
        fields = [tokens.dictionary.take(pa.array(term[starts])), pa.array(np.full(len(starts), shard, np.int32)), pa.array(most), pa.array(np.diff(ends)), *lists]
        yield pa.RecordBatch.from_arrays(fields, ["term", "shard", "bound", "n", "doc", "tf", "length", "distinct"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts = None, [], []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist() if len(shards) else []
            for start, end in zip(cuts, [*cuts[1:], len(shards)], strict=True) if cuts else ():
                if shards[start] != now and ids:
                    yield from blocks(now, ids, texts)
                    ids, texts = [], []
                now = int(shards[start])
                ids.append(batch.column(1).slice(start, end - start))
                texts.append(batch.column(2).slice(start, end - start))
        if ids:
            yield from blocks(now, ids, texts)

    def saturation(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))

    return run


def current(spark: SparkSession, path: str, source: str | None = None) -> Lexicon | None:
    """The index published last under ``path``; None if there is none, or if it was made of another ``source``."""
    files = Files(spark, path)
    if not files.exists(f"{path}/CURRENT"):
        return None
    at = f"{path}/{files.text(f'{path}/CURRENT')}"
    about = json.loads(files.text(f"{at}/catalogue.json"))
    if source is not None and about.pop("source") != source:
        return None
    about.pop("source", None)
    return Lexicon(spark, at, **about | {"stopwords": tuple(about["stopwords"])})


# --- BM25 ---


def saturation(tf: Column, length: Column, average: float) -> Column:
    """What a term's frequency adds to a score, but for its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def _asked_terms(queries: DataFrame, id: str, text: str, index: Lexicon) -> DataFrame:
    """(``query``, ``term``, ``idf``, ``most``): each query's distinct terms that documents have; ``most`` is the most that one can add."""
    asked = queries.select(F.col(id).alias("query"), F.explode(F.array_distinct(index_terms(F.col(text), index.stopwords))).alias("term")).distinct()
    idf = F.log(1 + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.terms(asked), "term").select("query", "term", "df", idf.alias("idf"), (idf * F.col("bound")).alias("most"))


def _added(index: Lexicon, terms: DataFrame, prune: Column | None = None) -> DataFrame:
    """(``query``, ``doc``, ``part``): sums of what ``terms`` add to each document that has one of them, over the blocks that pass ``prune``."""
    average = index.n_tokens / max(index.n_docs, 1) or 1.0
    rows = by_shard(index, terms, prune).select("shard", "query", "idf", F.explode("postings").alias("p"))
    parts = rows.select("shard", "query", "p.doc", (F.col("idf") * saturation(F.col("p.tf"), F.col("p.length"), average)).alias("part"))
    return parts.groupBy("shard", "query", "doc").agg(F.sum("part").alias("part")).drop("shard")


#: Bounds and sums of the same numbers in another order can differ by rounding; nothing this near to a threshold is pruned.
_SLACK = 1e-6


def bm25(queries: DataFrame, id: str, text: str, index: Lexicon, k: int = 50, prune: bool = True) -> DataFrame:
    """(``query``, ``doc``, ``score``, ``rank``): the ``k`` best documents of each query by BM25, score to 6 places, ties by document.

    With ``prune``, lists of common words are not unfolded. A query's rarest terms, until they have ``k`` postings,
    give a first threshold: no document below the k-th of their sums can be among the best. Terms whose bounds together stay
    below it cannot bring in a document by themselves; so candidates come from the other terms only, and of their blocks only
    from those that can still reach the threshold. The rest is looked up for the candidates alone, block by block.
    The result is that without pruning. Queries without a term that documents have get no row.
    """
    terms = stored(_asked_terms(queries, id, text, index), "asked")
    best = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    ranked = lambda rows: rows.withColumn("score", F.round("part", 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "doc", "score", "rank")
    if not prune:
        return ranked(_added(index, terms))
    rare = W.partitionBy("query").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    seeds = terms.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < k).drop("before")
    kth = lambda rows: rows.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("part")))).where(F.col("r") == k).select("query", (F.col("part") - _SLACK).alias("least"))
    first = stored(kth(_added(index, seeds)), "thresholds")
    rising = W.partitionBy("query").orderBy("most", F.desc("df"), "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    split = terms.join(first, "query", "left").withColumn("below", F.sum("most").over(rising)).withColumn("all", F.sum("most").over(W.partitionBy("query")))
    split = stored(split.withColumn("needed", F.col("least").isNull() | (F.col("below") >= F.col("least"))).drop("below"), "split")
    within = F.col("least").isNull() | (F.col("idf") * F.col("bound") + F.col("all") - F.col("most") >= F.col("least"))
    found = stored(_added(index, split.where("needed"), within), "found")
    later = split.where("not needed")
    if later.isEmpty():
        return ranked(found)
    # A second threshold, from more terms; then only candidates that can reach it are looked up in the lists put off.
    second = kth(found)
    rest = later.groupBy("query").agg(F.sum("most").alias("rest"))
    live = found.join(second, "query", "left").join(rest, "query", "left").where(F.col("least").isNull() | (F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("least")))
    live = stored(live.select("query", "doc", "part"), "live")
    return ranked(live.unionByName(_looked_up(index, later, live)).groupBy("query", "doc").agg(F.sum("part").alias("part")))


def _looked_up(index: Lexicon, terms: DataFrame, live: DataFrame) -> DataFrame:
    """What ``terms`` add to the documents of ``live(query, doc)``: a block is met by the candidates of its shard, and only those of its postings become rows."""
    average = index.n_tokens / max(index.n_docs, 1) or 1.0
    blocks = index.blocks(terms)
    shard = F.pmod(F.xxhash64("doc"), F.lit(index.shards)).cast("int")
    wanted = live.withColumn("shard", shard).groupBy("query", "shard").agg(F.collect_set("doc").alias("docs"))
    met = terms.select("query", "term", "idf").join(wanted, "query").join(blocks, ["term", "shard"])
    hits = met.select("query", "idf", F.explode(F.filter("postings", lambda p: F.array_contains("docs", p["doc"]))).alias("p"))
    return hits.select("query", "p.doc", (F.col("idf") * saturation(F.col("p.tf"), F.col("p.length"), average)).alias("part"))
