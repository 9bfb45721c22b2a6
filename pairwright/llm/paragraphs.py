"""Substring dedup: paragraphs by MinHash banding and exact Jaccard, and passages inside paragraphs by anchors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bagminhash import _items
from .decontam import _merge
from .store import BROADCAST_IDS, FINE, colliding_links, components, stored, wanted_ids, with_hot_keys
from .text import WordHashes, columns, distinct_sizes, list_column, mixed, runs_of_shingles, shingles, sketch, words_of

WIDTH, SIMILARITY, ROWS = 5, 0.8, 4
#: Paragraphs (lines) of fewer words are left alone.
MIN_WORDS = 20
#: A passage is found by windows of GRAM words; of any REACH windows in a row one is an anchor. So GRAM + REACH - 1 = 50 words in common are always found.
GRAM, REACH = 20, 31

_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNITS = ("doc bigint", "line int", "start int", "stop int", "size bigint", "one bigint", "two bigint", "bands array<bigint>", "sketch array<bigint>")
_ANCHORS = ("doc bigint", "pos int", "gram bigint", "step int", "block bigint")


def tuned_bands(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = 0.998) -> int:
    """The fewest bands of ``rows`` rows that bring a pair of ``similarity`` together with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def minhash(values: np.ndarray, starts: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """For each set, a run of well mixed ``values`` from its start on, the least salted hash by salt."""
    out, salted = np.empty((len(salts), len(starts)), np.uint64), np.empty_like(values)
    for k, s in enumerate(salts):
        np.multiply(np.bitwise_xor(values, s, out=salted), s | np.uint64(1), out=salted)
        np.minimum.reduceat(salted, starts, out=out[k])
    return np.ascontiguousarray(out.T)


class RunHashes:
    """Hashes of any runs of a sequence of word hashes, by order and content but not by place: a polynomial in an odd base, from prefix sums, divided by the base's power at the start. The powers are kept from text to text."""

    base, back = int(_ODD), pow(int(_ODD), -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) + 1
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(2 * n, b, np.uint64))) for b in (self.base, self.back))
        return np.append(np.uint64(0), np.cumsum(mixed(hashes) * self.up[: n - 1]))

    def runs(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((sums[stops] - sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))


def anchors_of(grams: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Positions of the windows, given by their hashes, that are least among some ``reach`` in a row (the last of equal ones)."""
    at, least, width, reach = np.arange(len(grams)), grams, 1, min(reach, len(grams))
    while width < reach:  # from the least of each ``width`` in a row to that of up to twice as many
        step = min(width, reach - width)
        at = np.where(least[step:] <= least[:-step], at[step:], at[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    return at[np.append(True, at[1:] != at[:-1])]


def _anchored(key: int, hashes: np.ndarray, hasher: RunHashes, gram: int, reach: int) -> tuple[np.ndarray, ...]:
    """A document's anchors: its id, where they stand, their windows' hashes, how far the next one is, and a hash of the words up to it."""
    sums, places = hasher.sums(hashes), np.arange(len(hashes) - gram + 1)
    every = hasher.runs(sums, places, places + gram)
    at = anchors_of(every, reach)
    step = np.diff(np.append(at, at[-1]))
    return np.full(len(at), key, np.int64), at.astype(np.int32), every[at].view(np.int64), step.astype(np.int32), hasher.runs(sums, at, at + step).view(np.int64)


def _marked(docs: DataFrame, id: str, text: str, min_words: int, bands: int, gram: int, reach: int) -> DataFrame:
    """From one reading of all texts: a row per paragraph of at least ``min_words`` words (place, words, a 128-bit
    hash of its words, and its bands), and a row per anchor of a document. The other's columns are null."""
    if min_words < WIDTH:
        raise ValueError("paragraphs must hold a shingle")
    salts = mixed(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * _ODD)
    fields = dict(f.split(" ") for f in (*_UNITS, *_ANCHORS))
    types = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}

    def rows(values: dict) -> pa.RecordBatch:
        n = len(values["doc"])
        return pa.RecordBatch.from_arrays([pa.array(values[f], types[t]) if f in values else pa.nulls(n, types[t]) for f, t in fields.items()], names=list(fields))

    def paragraphs(places: list[tuple], words: list[np.ndarray]) -> pa.RecordBatch:
        flat, sizes = np.concatenate(words), np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        grams, begins = runs_of_shingles(flat, starts, WIDTH)
        registers = minhash(grams, begins, salts)
        least = registers.reshape(len(words), bands, ROWS)
        keys = np.tile(np.arange(bands, dtype=np.uint64), (len(words), 1))
        for k in range(ROWS):
            keys = mixed(keys * _ODD + least[:, :, k])
        order = np.arange(len(flat), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
        ones, twos = (np.add.reduceat(mixed(mixed(flat ^ c) + order * _ODD), starts).view(np.int64) for c in (np.uint64(0), _ODD))
        doc, line, start, stop = zip(*places, strict=True)
        return rows({"doc": doc, "line": line, "start": start, "stop": stop, "size": distinct_sizes(grams, begins), "one": ones, "two": twos, "bands": list_column(keys), "sketch": list_column(sketch(registers))})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = WordHashes(), RunHashes()
        places, words, held = [], [], 0
        for some, texts in columns(batches, "id", "text"):
            anchors: list[tuple[np.ndarray, ...]] = []
            for key, value in zip(some, texts, strict=True):
                if key is None or not value:
                    continue
                at, lines = 0, []
                for n, line in enumerate(value.split("\n")):
                    w = known.of(words_of(line))
                    lines.append(w)
                    at += len(w)
                    if len(w) >= min_words:
                        places.append((key, n, at - len(w), at))
                        words.append(w)
                        held += len(w)
                        if held >= 100_000:
                            yield paragraphs(places, words)
                            places, words, held = [], [], 0
                if at >= gram:
                    anchors.append(_anchored(key, np.concatenate(lines), hasher, gram, reach))
            if anchors:
                yield rows(dict(zip(("doc", "pos", "gram", "step", "block"), map(np.concatenate, zip(*anchors, strict=True)), strict=True)))
        if places:
            yield paragraphs(places, words)

    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return stored(source.mapInArrow(mark, ", ".join(f"{f} {t}" for f, t in fields.items())), "paragraphs")


def _texts(docs: DataFrame, units: DataFrame, ids: DataFrame) -> DataFrame:
    """(``unit``, ``t``): the paragraph of each unit in ``ids``, from its first occurrence."""
    places = units.join(ids.withColumnRenamed("id", "unit"), "unit", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("line", "unit")).alias("u"))
    known = wanted_ids(places.select("doc"))
    lines = docs.join(known, "doc", "left_semi").join(places, "doc").select("text", F.explode("u").alias("u"))
    return lines.select("u.unit", F.get(F.split("text", "\n"), "u.line").alias("t")).groupBy("unit").agg(F.min("t").alias("t"))


def _jaccard(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` of unit ids whose paragraphs' shingle sets have a Jaccard similarity of at least ``similarity``."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        @lru_cache(maxsize=256)
        def of(text: str) -> frozenset:
            return frozenset(shingles(known.of(words_of(text)), WIDTH).tolist())

        for some, others, ones, twos in columns(batches, "a", "b", "ta", "tb"):
            rows = [(a, b) for a, b, x, y in zip(some, others, ones, twos, strict=True) if len(of(x) & of(y)) >= similarity * len(of(x) | of(y))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["a", "b"])

    both = pairs.join(lines.withColumnsRenamed({"unit": "b", "t": "tb"}), "b").join(lines.withColumnsRenamed({"unit": "a", "t": "ta"}), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(hold, "a bigint, b bigint")


def _fine_sketches(lines: DataFrame) -> DataFrame:
    """(``id``, ``sketch``) of ``FINE`` registers for ``lines(unit, t)``."""
    salts = mixed(np.arange(1, FINE + 1, dtype=np.uint64) * _ODD)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for units, texts in columns(batches, "unit", "t"):
            grams = [shingles(known.of(words_of(t)), WIDTH) for t in texts]
            sizes = np.array([len(g) for g in grams])
            rows = minhash(np.concatenate(grams), np.cumsum(sizes) - sizes, salts)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), list_column(sketch(rows))], names=["id", "sketch"])

    return lines.select("unit", "t").mapInArrow(sign, "id bigint, sketch array<bigint>")


def _paragraphs(docs: DataFrame, marks: DataFrame, id: str, text: str, similarity: float) -> DataFrame:
    """(``doc``, ``start``, ``stop``, ``class``) of every paragraph that is a later member of its class: equal
    paragraphs, and those linked by exact Jaccard of word shingles, as components. The first by document and line stays."""
    source = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    marks = marks.where("one is not null")
    # The unit's id is a hash of its words; the first occurrence of each stands for all equal ones.
    firsts = marks.groupBy("one", "two").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.select("one", "two", "n", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), F.col("one").alias("unit")), "paragraph-firsts")
    alone = marks.join(firsts.select("one", "two", "doc", "line"), ["one", "two", "doc", "line"], "left_semi")
    entries = alone.select(F.col("one").alias("id"), "size", F.explode("bands").alias("key"))  # repeated rows do no harm
    texts: list[DataFrame] = []

    def verify(pairs: DataFrame, ids: DataFrame) -> DataFrame:
        if not texts:
            texts.append(stored(_texts(source, firsts, ids), "paragraph-texts"))
        return _jaccard(pairs, texts[0], similarity).distinct()

    sketches = alone.select(F.col("one").alias("id"), "sketch")

    def items(some: DataFrame, ids: DataFrame) -> DataFrame:
        found = texts[0].join(some.withColumnRenamed("id", "unit"), "unit", "left_semi")
        return _items(found.select(F.col("unit").alias("id"), F.col("t").alias("text")), WIDTH).withColumn("n", F.lit(1).cast("bigint"))

    def finer(some: DataFrame, ids: DataFrame) -> DataFrame:
        return _fine_sketches(texts[0].join(some.withColumnRenamed("id", "unit"), "unit", "left_semi"))

    links = colliding_links(entries, sketches, tuned_bands(similarity) * ROWS, similarity, verify, items, finer)
    roots = components(links)
    classes = firsts.join(roots.withColumnRenamed("id", "unit"), "unit", "left").where("n > 1 or root is not null").withColumn("class", F.coalesce("root", "unit"))
    keep = stored(classes.groupBy("class").agg(F.min(F.struct("doc", "line")).alias("keep"), F.count("*").alias("members")), "paragraph-keeps")
    ruled = stored(with_hot_keys(classes.select("one", "two", "class", "n"), keep, ["class"], "members").drop("members"), "paragraph-classes")
    return with_hot_keys(marks.select("doc", "line", "start", "stop", "one", "two"), ruled, ["one", "two"], "n").where(F.struct("doc", "line") != F.col("keep")).select("doc", "start", "stop", "class")


def _around(docs: DataFrame, spots: DataFrame, id: str, text: str, gram: int, reach: int) -> DataFrame:
    """(``doc``, ``pos``, ``before``, ``after``): hashes of the ``reach`` - 1 words on each side of the windows at ``spots(doc, pos)``, nearest first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = WordHashes(), reach - 1
        kinds = {"doc": pa.int64(), "pos": pa.int32(), "before": pa.list_(pa.int64()), "after": pa.list_(pa.int64())}
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for keys, texts, lists in columns(batches, "doc", "text", "at", rows=64):
            for key, value, at in zip(keys, texts, lists, strict=True):
                h = known.of(words_of(value)).view(np.int64)
                for k in at:
                    if k + gram <= len(h):  # rows may share an id, and then only one has the window
                        rows.append((key, k, h[max(0, k - n) : k][::-1], h[k + gram : k + gram + n]))
                    if len(rows) >= 5_000:
                        yield flush()
                        rows = []
        if rows:
            yield flush()

    places = stored(spots.groupBy("doc").agg(F.collect_set("pos").alias("at")), "edge-places")
    if (places.agg(F.sum(F.size("at") + 4)).first()[0] or 0) <= BROADCAST_IDS:
        places = F.broadcast(places)
    source = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = source.join(places, "doc").mapInArrow(cut, "doc bigint, pos int, before array<bigint>, after array<bigint>")
    return stored(found, "edge-words").dropDuplicates(["doc", "pos"])


def _passages(docs: DataFrame, marks: DataFrame, id: str, text: str, gram: int, reach: int) -> DataFrame:
    """(``doc``, ``start``, ``stop``) of word spans that occur before, in a document of lesser id or earlier in the same.

    Anchors are chosen by content, so a passage has the same ones wherever it stands. Those that occur again are
    joined with their first occurrence only, so a passage in very many documents makes as many rows as it has
    occurrences. A span reaches from one anchor to the next where the words between are the same as there, or as
    in another earlier place. Where they are not, the passage ends, or begins, within ``reach`` words: there the
    words on both sides are compared one by one with those around the first occurrence.
    """
    anchors = marks.where("gram is not null").select(*[f.split(" ")[0] for f in _ANCHORS])
    firsts = anchors.groupBy("gram").agg(F.min(F.struct("doc", "pos", "step", "block")).alias("f"), F.count("*").alias("n")).where("n > 1")
    again = with_hot_keys(anchors, stored(firsts, "anchor-firsts"), ["gram"], "n").where((F.col("doc") != F.col("f.doc")) | (F.col("pos") != F.col("f.pos")))
    same = (F.col("step") > 0) & (F.col("step") == F.col("f.step")) & (F.col("block") == F.col("f.block"))
    again = stored(again.select("doc", "pos", "gram", "step", "block", same.alias("same"), F.col("f.doc").alias("f_doc"), F.col("f.pos").alias("f_pos")), "anchor-again")
    stretch = ["gram", "step", "block"]
    other = again.where("not same and step > 0")
    shared = stored(other.groupBy(*stretch).agg(F.min(F.struct("doc", "pos")).alias("g"), F.count("*").alias("n")).where("n > 1"), "anchor-stretches")
    later = with_hot_keys(other, shared, stretch, "n").where(F.struct("doc", "pos") != F.col("g")).select("doc", "pos", F.lit(True).alias("later")).distinct()
    rows = again.join(later, ["doc", "pos"], "left").withColumn("same", F.col("same") | F.coalesce("later", F.lit(False)))
    rows = rows.withColumn("stop", F.col("pos") + F.when(F.col("same"), F.greatest(F.lit(gram), F.col("step"))).otherwise(F.lit(gram)))
    order = W.partitionBy("doc").orderBy("pos")
    reached = F.max(F.when(F.col("same"), F.col("pos") + F.col("step"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(reached < F.col("pos"), F.lit(True))
    goes_on = F.col("same") & F.coalesce(F.lead("pos").over(order) == F.col("pos") + F.col("step"), F.lit(False))  # the next anchor occurs again as well
    rows = stored(rows.withColumns({"begins": begins, "goes_on": goes_on}).select("doc", "pos", "stop", "f_doc", "f_pos", "begins", "goes_on"), "anchor-spans")
    edges = rows.where("begins or not goes_on")
    spots = edges.select("doc", "pos").union(edges.select("f_doc", "f_pos")).distinct()
    words = _around(docs, spots, id, text, gram, reach)
    counts = edges.groupBy("f_doc", "f_pos").agg(F.count("*").alias("n"))
    theirs = stored(words.select(F.col("doc").alias("f_doc"), F.col("pos").alias("f_pos"), F.col("before").alias("f_before"), F.col("after").alias("f_after")).join(counts, ["f_doc", "f_pos"]), "edge-firsts")
    both = with_hot_keys(edges.join(words, ["doc", "pos"]), theirs, ["f_doc", "f_pos"], "n")

    def alike(a: str, b: str) -> Column:
        """How many words are the same from the window on."""
        unlike = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
        return F.when(unlike > 0, unlike - 1).otherwise(F.size(a)).cast("int")

    left, right = F.when(F.col("begins"), alike("before", "f_before")).otherwise(0), F.when(~F.col("goes_on"), alike("after", "f_after")).otherwise(0)
    grown = both.select("doc", (F.col("pos") - left).alias("start"), (F.col("pos") + gram + right).alias("stop"))
    return rows.select("doc", F.col("pos").alias("start"), "stop").unionByName(grown)


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: ``id`` and ``spans``, the merged word spans (words: lower-case runs of letters and
    digits) that repeat what stands in an earlier place, as paragraphs or as passages inside them. Of equal
    paragraphs, and of those that are alike, the first by document and line is none.

    Ids are whole numbers. Null, wordless and short texts have no span. Rows that share an id are one document, of which equal rows
    count once; rows with a null id have no span. An empty table gives an empty one.
    """
    marks = _marked(docs, id, text, min_words, tuned_bands(similarity), gram, reach)
    spans = _paragraphs(docs, marks, id, text, similarity).select("doc", "start", "stop").unionByName(_passages(docs, marks, id, text, gram, reach))
    merged = spans.groupBy("doc").agg(_merge(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    rows = docs.select(F.col(id).alias("id")).join(merged, F.col("id").cast("bigint") == F.col("doc"), "left")
    return rows.select("id", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"))
