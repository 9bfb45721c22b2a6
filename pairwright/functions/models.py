"""Places for models, each with a default that needs none: embeddings, reranking and entailment.

A model is a function from a DataFrame of texts to the same rows with a score or vector, in whatever way suits it (a
pandas function, a table of answers). Nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checks import ACTION, FLAGS, flag
from .text import let, matches, softmax

Model = Callable[[DataFrame], DataFrame]

# Limits of the entailment check and of the sentence review.
CONTRADICTION, ENTAILMENT = 0.5, 0.5
REVIEW_CONTRADICTION, REVIEW_NEUTRAL, REVIEW_WORDS = 0.55, 0.60, 4


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A vector of word counts by hash, of length 1; all zero without words."""
    places = F.transform(matches(F.lower(text), "[a-z0-9]+"), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("double")))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

    return let(counts, unit)


#: Bytes of texts that are counted at a time.
_PIECE = 1 << 20


def letter_profile(text: Column) -> Column:
    """How often a text has each letter from a to z, whatever its case: 26 counts as a vector. Null and letterless texts give zeros. Texts are counted in Arrow tasks, each in one reading, not one for each letter."""

    def counts(texts: pa.Array) -> pa.Array:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        out = np.zeros(26 * len(texts))
        for at in range(int(offsets[0]), int(offsets[-1]), _PIECE):
            end = min(at + _PIECE, int(offsets[-1]))
            letter = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at:end] - np.uint8(97)  # others are 26 or more
            first, last = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, end)
            row = np.repeat(np.arange(0, 26 * (last - first), 26), np.diff(np.clip(offsets[first : last + 1], at, end)))
            known = letter < 26
            out[26 * first : 26 * last] += np.bincount(row[known] + letter[known], minlength=26 * (last - first))
        return pa.ListArray.from_arrays(np.arange(0, len(out) + 1, 26, dtype=np.int32), out)

    return F.arrow_udf(counts, "array<double>")(F.lower(F.coalesce(text, F.lit(""))))


def embedded(rows: DataFrame, text: str, vector: str = "vector", model: Model | None = None) -> DataFrame:
    """``rows`` with a vector each, by the model or by hashing."""
    return model(rows) if model else rows.withColumn(vector, hash_embedding(F.col(text)))


def reranked(hits: DataFrame, model: Model | None = None) -> DataFrame:
    """``hits`` with ``rank`` by the model's ``relevance``; without a model as they are."""
    from pyspark.sql.window import Window as W

    if model is None:
        return hits
    return model(hits).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("relevance"), "rank")))


def entailment_flags(sentence: Column, logits: Column) -> Column:
    """Flags of a draft sentence that states an action, from scores of contradiction, neutral and entailment: contradicted by the source, or not supported by it."""

    def judge(p: Column) -> Column:
        wrong, bare = p[0] >= CONTRADICTION, p[2] < ENTAILMENT
        return F.when(wrong, F.array(flag("nli_contradiction", "fail", "the source contradicts this sentence", F.array(sentence)))).when(bare, F.array(flag("nli_unsupported", "fail", "the source does not support this sentence", F.array(sentence)))).otherwise(F.array().cast(FLAGS))

    return F.when(sentence.rlike(ACTION), let(softmax(logits), judge)).otherwise(F.array().cast(FLAGS))


def reviewed_level(level: Column, sentence: Column, logits: Column) -> Column:
    """A sentence's level after entailment: red if contradicted; amber if still green, four words or more, and neutral."""
    enough = F.size(matches(sentence, r"\S+")) >= REVIEW_WORDS
    return let(softmax(logits), lambda p: F.when(enough & (p[0] >= REVIEW_CONTRADICTION), "red").when(enough & (level == "green") & (p[1] >= REVIEW_NEUTRAL), "amber").otherwise(level))
