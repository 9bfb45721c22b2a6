"""Near-duplicates by BagMinHash: signatures for weighted Jaccard from hierarchical Poisson processes, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import FINE, colliding_links, components, stored, wanted_ids
from .text import WordHashes, columns, list_column, mixed, shingles, sketch, words_of

WIDTH = 5
SIMILARITY = 0.8
#: Bands of rows: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^6)^24 > 0.999.
BANDS, ROWS = 24, 6
#: Units that a task hashes at once.
UNITS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = "id bigint, size bigint, one bigint, two bigint, bands array<bigint>, sketch array<bigint>"


def bag(words: list[bytes], known: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of a text, sorted, and how often each occurs."""
    return np.unique(shingles(known.of(words), width), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: sum of least over sum of greatest counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / max(1, int(a[1].sum()) + int(b[1].sum()) - least)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``registers`` times per bag; two bags agree in a register with the probability of their weighted Jaccard similarity.

    Weights are cut into the dyadic ranges [0, 1), [1, 2), [2, 4), ... Each range of each shingle has a Poisson
    process of its own, with the range's length as rate; its points come in order of time, with a register and a
    weight each, all drawn from a hash of shingle, range and number of the point. A point counts if its weight is
    below the bag's. So bags share exactly the points below the lesser weight, and a register, which keeps the
    earliest point, is the same in both as often as that point is a shared one. A range is done when its time has
    passed the latest of the registers. Heavy shingles need as many ranges as their weight has binary digits.
    """
    seeds, owner, low, rate, weight = [], [], [], [], []
    for k, (values, counts) in enumerate(bags):
        for j in range(int(counts.max()).bit_length() + 1 if len(counts) else 0):
            floor = 0 if j == 0 else 1 << (j - 1)
            has = counts > floor
            if has.any():
                seeds.append(mixed(values[has] + np.uint64(j * int(_ODD) % (1 << 64))))
                n = len(seeds[-1])
                owner.append(np.full(n, k, np.int64))
                low.append(np.full(n, floor, np.float64))
                rate.append(np.full(n, max(1, floor), np.float64))
                weight.append(counts[has].astype(np.float64))
    out = np.full(len(bags) * registers, np.inf)
    if not seeds:
        return out.reshape(len(bags), registers)
    seeds, owner, low, rate, weight = (np.concatenate(x) for x in (seeds, owner, low, rate, weight))
    time, number = np.zeros(len(seeds)), 0
    while len(seeds):
        number += 1
        draw = mixed(seeds + np.uint64(number * int(_ODD) % (1 << 64)))
        time = time - np.log((((draw >> np.uint64(11)).astype(np.float64)) + 0.5) / (1 << 53)) / rate
        second = mixed(draw ^ _ODD)
        register = ((second >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        inside = low + (second & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32) * rate < weight
        np.minimum.at(out, (owner * registers + register)[inside], time[inside])
        latest = out.reshape(-1, registers).max(axis=1)
        left = time < latest[owner]
        seeds, owner, low, rate, weight, time = (x[left] for x in (seeds, owner, low, rate, weight, time))
    return out.reshape(len(bags), registers)


def signed(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row with a word and an id: ``id``, ``size`` (shingles with repeats), a 128-bit hash of the bag (``one``, ``two``), ``bands``, a hash of each band's registers, and ``sketch``, some bits of each register."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def finish(ids: list[int], bags: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            whole_rows = signatures(bags, bands * rows).view(np.uint64)
            cut = whole_rows.reshape(len(bags), bands, rows)
            keys = np.tile(np.arange(bands, dtype=np.uint64), (len(bags), 1))
            for k in range(rows):
                keys = mixed(keys * _ODD + cut[:, :, k])
            ones = [int((mixed(v) * c.astype(np.uint64)).sum(dtype=np.uint64)) for v, c in bags]
            twos = [int((mixed(v ^ _ODD) * c.astype(np.uint64)).sum(dtype=np.uint64)) for v, c in bags]
            whole = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            sizes = pa.array([int(c.sum()) for _, c in bags], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), sizes, whole(ones), whole(twos), list_column(keys), list_column(sketch(whole_rows))], names=["id", "size", "one", "two", "bands", "sketch"])

        ids, bags, units = [], [], 0
        for some, texts in columns(batches, "id", "text"):
            for key, value in zip(some, texts, strict=True):
                if key is None or not (words := words_of(value)):
                    continue
                ids.append(key)
                bags.append(bag(words, known, width))
                units += len(bags[-1][0])
                if units >= UNITS:
                    yield finish(ids, bags)
                    ids, bags, units = [], [], 0
        if ids:
            yield finish(ids, bags)

    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(sign, _SIGNED)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose bags overlap by at least ``similarity``."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        @lru_cache(maxsize=32)
        def head(a: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            return bag(words_of(text), known, width)

        for some, others, heads, texts in columns(batches, "a", "b", "ta", "tb"):
            keep = [overlap(head(a, ta), bag(words_of(tb), known, width)) >= similarity for a, ta, tb in zip(some, heads, texts, strict=True)]
            rows = [(a, b) for a, b, k in zip(some, others, keep, strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["a", "b"])

    both = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(hold, "a bigint, b bigint")


def _items(texts: DataFrame, width: int) -> DataFrame:
    """(``id``, ``item``, ``n``): the shingles of each text and how often it has them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for ids, values in columns(batches, "id", "text"):
            for key, value in zip(ids, values, strict=True):
                items, counts = bag(words_of(value), known, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), key, np.int64)), pa.array(items.view(np.int64)), pa.array(counts.astype(np.int64))], names=["id", "item", "n"])

    return texts.select("id", "text").mapInArrow(spread, "id bigint, item bigint, n bigint").groupBy("id", "item").agg(F.max("n").alias("n"))


def _fine_sketches(texts: DataFrame, width: int) -> DataFrame:
    """(``id``, ``sketch``) of ``FINE`` registers; of rows that share an id the first."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for ids, values in columns(batches, "id", "text"):
            pairs = [(i, bag(w, known, width)) for i, v in zip(ids, values, strict=True) if (w := words_of(v))]
            if pairs:
                rows = signatures([b for _, b in pairs], FINE).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), list_column(sketch(rows))], names=["id", "sketch"])

    return texts.select("id", "text").mapInArrow(sign, "id bigint, sketch array<bigint>").groupBy("id").agg(F.first("sketch").alias("sketch"))


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(``id``, ``class_id``) for each row of ``docs``: the least id of the component of texts whose bags of word
    shingles overlap by at least ``similarity`` (weighted Jaccard), directly or over others.

    Ids are whole numbers. Texts with equal bags are copies: they are collapsed by hash before anything is paired. The rest are banded;
    colliding ids are verified on their whole texts. Words are lower-case runs of letters and digits; a text of
    fewer than ``width`` words is one shingle; null and wordless texts are in classes of their own. Rows that
    share an id are one document, with the texts of all; a null id has a null class. An empty table gives an empty one.
    """
    marks = stored(signed(docs, id, text, width), "signatures")
    firsts = stored(marks.groupBy("one", "two", "size").agg(F.min("id").alias("first")), "copies")
    copies = marks.select("id", "one", "two", "size").join(firsts, ["one", "two", "size"]).select("id", "first")
    entries = marks.join(firsts.select(F.col("first").alias("id"), "one", "two", "size"), ["id", "one", "two", "size"], "left_semi").select("id", "size", F.explode("bands").alias("key"))  # repeated rows do no harm
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))

    texts: list[DataFrame] = []

    def verify(pairs: DataFrame, ids: DataFrame) -> DataFrame:
        if not texts:
            texts.append(stored(source.join(wanted_ids(ids), "id", "left_semi"), "texts"))
        return _verified(pairs, texts[0], similarity, width).distinct()

    def items(some: DataFrame, ids: DataFrame) -> DataFrame:
        return _items(texts[0].join(wanted_ids(some), "id", "left_semi"), width)

    def finer(some: DataFrame, ids: DataFrame) -> DataFrame:
        return _fine_sketches(texts[0].join(wanted_ids(some), "id", "left_semi"), width)

    links = colliding_links(entries, marks.select("id", "sketch"), BANDS * ROWS, similarity, verify, items, finer)
    roots = components(links.unionByName(copies.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))))
    return source.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("class_id"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` less those of whose class another document has a smaller id; of rows that share an id one stays. Rows with a null id stay."""
    found = stored(classes(docs, id, text, similarity, width), "classes")
    gone = found.where("id <> class_id").select(F.col("id").alias(id)).distinct()
    rest = docs.join(gone, id, "left_anti").select(docs.columns)
    again = stored(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(id)), "repeated")
    if again.isEmpty():
        return rest
    return rest.join(again, id, "left_anti").select(docs.columns).unionByName(rest.join(again, id, "left_semi").select(docs.columns).dropDuplicates([id]))
