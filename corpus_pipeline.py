"""From raw documents to a training mix, in five stages; each one's result is written as Parquet and read again by the next.

Each stage keeps the columns of its documents, whatever their names, and gives an empty table for an empty one. Null
and empty texts fail the base rule and go in the first stage; where a later stage meets one it leaves it alone, and the
mix takes it with its block. Texts of any length are used whole. Rows that share an id are one document to line dedup and
near-dedup, which keeps one of them; of equal ones elsewhere all stay or all go. Null ids are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import bagminhash, decontam, linededup, mixing, quality
from pairwright.llm.store import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the threshold table rejects go."""
    return quality.judge(docs).where("quality.kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of a line go from the texts; a document that consisted of such lines and blanks only goes whole."""
    done = linededup.dedup(docs)
    left = done.where((F.col("lines.n_removed") == 0) | F.col("text").rlike(r"[^\s]"))
    return left.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return bagminhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and at the places, that the mix of sources gives them."""
    mixed = mixing.mix(docs)
    return mixed.select(*docs.columns, "mix.n_tokens", "mix.epoch", "mix.block", F.round("mix.source_weight", 6).alias("source_weight"), F.round("mix.position", 9).alias("position"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Near-duplicate classes come from hashed signatures; the tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
