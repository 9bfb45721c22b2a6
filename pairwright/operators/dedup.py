"""Duplicates by id, by content and by near-equal wording, and what stays of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, squeezed, word_shingles
from ..sources.checkpoints import stored
from .assemble import first_by
from .graph import components


#: Up to so many ids are sent to all tasks to fetch what belongs to them (16 MB); beyond, they are joined by shuffling.
BROADCAST_IDS = 1_000_000


def by_id(rows: DataFrame, id: str, order: list[Column]) -> DataFrame:
    return first_by(rows, [id], order)


def content_id(*texts: Column, chars: int | None = None, digits: int = 10) -> Column:
    """A short hash of the texts; with ``chars``, of that many characters of each only."""
    return F.substr(F.md5(F.concat(*[F.left(t, F.lit(chars)) if chars else t for t in texts])), F.lit(1), F.lit(digits))


def within(rows: DataFrame, chosen: DataFrame, id: str) -> DataFrame:
    """The rows whose id is among the chosen."""
    return rows.join(chosen.select(id).distinct(), id, "left_semi")


def new_texts(rows: DataFrame, known: DataFrame, text: str, id: str) -> DataFrame:
    """Rows whose text, case and white space aside, is not in ``known``; of equal ones that of the least id."""
    norm = F.lower(squeezed(F.col(text)))
    fresh = rows.withColumn("_n", norm).join(known.select(norm.alias("_n")).distinct(), "_n", "left_anti")
    return first_by(fresh, ["_n"], [F.col(id)]).drop("_n")


def _shingled(rows: DataFrame, id: str, text: Column, words: int, pattern: str) -> DataFrame:
    """(``id``, ``s``, ``h``): the distinct word shingles as 64-bit hashes, and a hash of their set; written down, for every step reads them."""
    return stored(rows.where(text.isNotNull()).select(F.col(id).alias("id"), F.array_sort(F.transform(word_shingles(text, words, pattern), lambda x: F.xxhash64(x))).alias("s")).withColumn("h", F.xxhash64("s")), "shingles")


def _signatures(sets: DataFrame, hashes: int) -> DataFrame:
    """``sets(id, s)`` as (``id``, ``m0``, ``m1``, ...): the least of each of ``hashes`` hashes over the set, with its items as rows: an expression for each item of an array would not be compiled."""
    return sets.select("id", F.explode("s").alias("x")).groupBy("id").agg(*[F.min(F.xxhash64(F.lit(k), "x")).alias(f"m{k}") for k in range(hashes)])


def _near_pairs(base: DataFrame, similarity: float, bands: int, width: int) -> DataFrame:
    """Equal sets have equal bands, so they are reduced to one before banding; the sets travel with the candidates only."""
    first = _marked(base.groupBy("h").agg(F.min("id").alias("id")).select("id"), "firsts")
    reps = base.join(first, "id", "left_semi").select("id", "s")
    band = lambda b: F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.col(f"m{b * width + k}") for k in range(width)]).alias("key"))
    keys = stored(_signatures(reps, bands * width).select("id", F.explode(F.array(*[band(b) for b in range(bands)])).alias("k")).select("id", "k.*"), "bands")
    pairs = keys.alias("x").join(keys.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = stored(pairs, "candidates")
    sets = base.join(_marked(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidate-ids"), "id", "left_semi")
    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return with_sets.withColumn("similarity", F.round(jaccard(F.col("sa"), F.col("sb")), 6)).where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def _marked(ids: DataFrame, name: str) -> DataFrame:
    """``ids`` written down, and sent to all tasks if counted to be few enough, so that no set is shuffled to be left out."""
    ids = stored(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_pairs(rows: DataFrame, id: str, text: Column, similarity: float = 0.85, bands: int = 12, width: int = 4, words: int = 3, pattern: str = r"(?U)\w+") -> DataFrame:
    """(``a``, ``b``, ``similarity``) of ids whose word shingles have a Jaccard similarity of at least ``similarity``.

    MinHash bands find candidates, the exact similarity of the shingles' 64-bit hashes decides. Of equal texts
    the one of least id stands for all. Null texts have no pair.
    """
    return _near_pairs(_shingled(rows, id, text, words, pattern), similarity, bands, width)


def near_classes(rows: DataFrame, id: str, text: Column, similarity: float = 0.85, exempt: Column | None = None) -> DataFrame:
    """(``id``, ``keep``): the least id of each class of near-duplicates; exempt rows are classes of their own."""
    used = rows.where(~exempt) if exempt is not None else rows
    base = _shingled(used, id, text, 3, r"(?U)\w+")
    equal = base.select("id", "h").join(base.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "h").where("id <> rep")
    links = _near_pairs(base, similarity, 12, 4).select("a", "b").unionByName(equal.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return rows.select(F.col(id).alias("id")).join(components(links), "id", "left").select("id", F.coalesce("root", "id").alias("keep"))
