"""Benchmark decontamination by a positional inverted index over the training tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored
from .text import WordHashes, columns, words_of

#: Words in a shard of the index; a longer document has a shard to itself.
SHARD_WORDS = 100_000
#: Words of test items that go to the tasks at once; a larger benchmark is taken in blocks of about this size.
QUERY_WORDS = 1_000_000

_INDEX = "shard bigint, terms binary, ends binary, positions binary, starts binary, ids array<bigint>"
_FOUND = "shard bigint, ord int, id bigint, n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"


def _shard(number: int, ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """One row: the sorted terms, where each one's posting list ends, the lists, and where each document starts."""
    lengths = np.array([len(h) for h in hashes], np.int64)
    tokens = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    positions = np.argsort(tokens, kind="stable").astype(np.int32)
    ordered = tokens[positions]
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if len(ordered) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = [[number], [ordered[last].tobytes()], [(last + 1).astype(np.int32).tobytes()], [positions.tobytes()], [starts.tobytes()], [ids]]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["shard", "terms", "ends", "positions", "starts", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional inverted index of all tokens of ``docs``, stored in the shared folder.

    The index is partitioned by documents: a shard holds the postings of about ``shard_words`` words as sorted
    64-bit term hashes, list ends and positions. Building it needs no shuffle, a shard's size is bounded but for
    a single longer document, and a term in a third of all documents is spread over all shards.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, hashes, size = WordHashes(), [], [], 0
        number = TaskContext.get().partitionId() << 32
        for some, texts in columns(batches, "id", "text"):
            for key, value in zip(some, texts, strict=True):
                h = known.of(words_of(value))
                if ids and size + len(h) > shard_words:
                    yield _shard(number, ids, hashes)
                    number, ids, hashes, size = number + 1, [], [], 0
                ids.append(key)
                hashes.append(h)
                size += len(h)
        if ids:
            yield _shard(number, ids, hashes)

    return stored(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(build, _INDEX), "postings")


def _windows(items: list[tuple[str, str]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The items' terms, sorted; all windows as numbers of terms; lengths; numbers of item names; and these. Equal windows stay, for each item has its own."""
    known, rows, lengths, owners = WordHashes(), [], [], []
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    for name, text in items:
        h = known.of(words_of(text))
        if not len(h):
            continue
        w = min(width, len(h))
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        rows.append(np.pad(view, ((0, 0), (0, width - w))))
        lengths.append(np.full(len(view), w, np.int32))
        owners.append(np.full(len(view), number[name], np.int32))
    if not rows:
        return np.zeros(0, np.uint64), np.zeros((0, width), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), names
    words = np.concatenate(rows)
    terms, numbers = np.unique(words, return_inverse=True)
    return terms, numbers.reshape(words.shape).astype(np.int32), np.concatenate(lengths), np.concatenate(owners), names


def _place(asked: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """For each asked term its number in the shard's, or -1."""
    if not len(asked) or not len(terms):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
    same = asked[at] == terms
    out = np.full(len(asked), -1)
    out[at[same]] = np.flatnonzero(same)
    return out


def _occurrences(place: np.ndarray, ends: np.ndarray, positions: np.ndarray, starts: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (window, first position) where a window's words stand in order inside one document of the shard. ``place``: where the asked terms' lists are."""
    none = np.zeros(0, np.int64)
    if not len(ends) or not len(windows):
        return none, none
    width = windows.shape[1]
    used = np.arange(width) < lengths[:, None]
    at = place[windows]
    whole = np.flatnonzero(((at >= 0) | ~used).all(axis=1))
    if not len(whole):
        return none, none
    at, used = at[whole], used[whole]
    firsts = np.concatenate([[0], ends[:-1]])
    counts = np.where(used, (ends - firsts)[at], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")  # each window's words, rarest first
    rows = np.arange(len(whole))
    rare = order[:, 0]
    n = counts[rows, rare]
    window = np.repeat(rows, n)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    begin = positions[firsts[at[rows, rare]][window] + inside].astype(np.int64) - rare[window]
    stop = begin + lengths[whole][window]
    fits = (begin >= 0) & (stop <= starts[-1])
    window, begin = window[fits], begin[fits]
    term_at = np.empty(len(positions), np.int64)
    term_at[positions] = np.repeat(np.arange(len(ends)), ends - firsts)
    for k in range(1, width):  # the other lists, moved by the word's offset, from the next rarest on
        word = order[window, k]
        here = used[window, word]
        keep = ~here | (term_at[np.where(here, begin + word, 0)] == at[window, word])
        window, begin = window[keep], begin[keep]
    document = np.searchsorted(starts, begin, "right")
    keep = begin + lengths[whole][window] <= starts[np.minimum(document, len(starts) - 1)]
    return whole[window[keep]], begin[keep]


def _least_covers(at: np.ndarray, word: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of every run of ``at`` that holds each word as often as ``need`` says, and loses one of them if it is made shorter."""
    have, missing, first, last = np.zeros(len(need), np.int64), len(need), 0, -1
    for k, w in enumerate(word):
        have[w] += 1
        missing -= have[w] == need[w]
        if missing:
            continue
        while have[word[first]] > need[word[first]]:
            have[word[first]] -= 1
            first += 1
        if first > last:  # a run with the same beginning is longer than one that was given
            yield at[first], at[k]
            last = first


def _near(place: np.ndarray, ends: np.ndarray, positions: np.ndarray, starts: np.ndarray, windows: np.ndarray, lengths: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (window, first, stop) of a shortest run of words inside one document that holds all words of a window, each as often as it does, in any order, and is at most ``slop`` words longer.

    Occurrences of a window's rarest word are candidates; one goes as soon as another word of the window, from the
    next rarest on, has no posting near enough in the same document. Around those that are left the posting lists
    are merged, and one pass over them gives the runs.
    """
    none = np.zeros(0, np.int64)
    if not len(ends) or not len(windows):
        return none, none, none
    width, total = windows.shape[1], int(starts[-1])
    used = np.arange(width) < lengths[:, None]
    at = place[windows]
    whole = np.flatnonzero(((at >= 0) | ~used).all(axis=1))
    if not len(whole):
        return none, none, none
    at, used, most = at[whole], used[whole], lengths[whole] + slop
    firsts = np.concatenate([[0], ends[:-1]])
    counts = np.where(used, (ends - firsts)[at], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")
    rows = np.arange(len(whole))
    rare = at[rows, order[:, 0]]
    n = counts[rows, order[:, 0]]
    window = np.repeat(rows, n)
    middle = positions[firsts[rare][window] + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
    document = np.searchsorted(starts, middle, "right")
    low = np.maximum(middle - most[window] + 1, starts[document - 1])
    high = np.minimum(middle + most[window], starts[np.minimum(document, len(starts) - 1)])
    listed = np.repeat(np.arange(len(ends)), ends - firsts) * (total + 1) + positions  # all lists, one after the other, in order
    for k in range(1, width):
        word = order[window, k]
        begin = at[window, word] * (total + 1) + low
        found = np.searchsorted(listed, begin)
        keep = ~used[window, word] | (listed[np.minimum(found, len(listed) - 1)] < begin - low + high) & (found < len(listed))
        window, low, high = window[keep], low[keep], high[keep]
    out: set[tuple[int, int, int]] = set()
    for w, a, z in zip(window.tolist(), low.tolist(), high.tolist(), strict=True):
        terms, need = np.unique(at[w][used[w]], return_counts=True)
        parts = [listed[slice(*np.searchsorted(listed, [t * (total + 1) + a, t * (total + 1) + z]))] - t * (total + 1) for t in terms.tolist()]
        places, word = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        by_place = np.argsort(places, kind="stable")
        out.update((int(whole[w]), int(x), int(y) + 1) for x, y in _least_covers(places[by_place], word[by_place], need) if y - x < most[w])
    return tuple(np.array(x, np.int64) for x in zip(*sorted(out), strict=True)) if out else (none, none, none)


def _merge(spans: Column) -> Column:
    """Overlapping and touching spans made one."""
    start = F.expr("cast(array() as array<struct<start:int,stop:int>>)")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= x["start"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(spans), start, add)


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = 10, slop: int | None = None, query_words: int = QUERY_WORDS) -> DataFrame:
    """Per indexed document: ``id`` (a whole number or null), ``n_words``, ``spans`` (word positions inside any match, merged) and ``items`` (names of matching items, sorted as strings).

    Each shard looks up a window's words, takes the shortest posting list, and intersects the others with it,
    moved by their offsets, from the rarest on. ``slop`` None: exact phrases; a number: proximity, all words of a
    window, each as often as it has them, in any order within its length plus ``slop`` words of one document; of
    runs that hold such a one only the shortest count. The items are a query set: they go to the shards in
    blocks of about ``query_words`` words, so no broadcast grows with the benchmark; blocks are merged by
    document. Null and wordless texts match nothing and have ``n_words`` 0; an item shorter than ``width`` is one
    window; repeated items count once by name, repeated documents each; an item with a null id is skipped.
    """
    spark = index.sparkSession
    named = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where("name is not null and text is not null")
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * query_words)))
    parts = []
    for b in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(_windows([tuple(r) for r in rows], width))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, windows, lengths, owners, names = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    terms, ends, positions, starts = (np.frombuffer(row[k], d) for k, d in (("terms", np.uint64), ("ends", np.int32), ("positions", np.int32), ("starts", np.int32)))
                    ends, starts = ends.astype(np.int64), starts.astype(np.int64)
                    place = _place(asked, terms)
                    if slop is None:
                        found, begin = _occurrences(place, ends, positions, starts, windows, lengths)
                        stop = begin + lengths[found]
                    else:
                        found, begin, stop = _near(place, ends, positions, starts, windows, lengths, slop)
                    marks = np.zeros(starts[-1] + 1, np.int32)
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, stop, -1)
                    hit = np.diff(np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]]))
                    docs = np.searchsorted(starts, begin, "right") - 1
                    pairs = np.unique(np.stack([docs, owners[found]]), axis=1) if len(docs) else np.zeros((2, 0), np.int64)
                    n = len(row["ids"])
                    spans, matched = [[] for _ in range(n)], [[] for _ in range(n)]
                    for a, z in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1), strict=True):
                        while a < z:  # a run of hits may cross from one document into the next
                            d = int(np.searchsorted(starts, a, "right")) - 1
                            end = min(z, starts[d + 1])
                            spans[d].append({"start": int(a - starts[d]), "stop": int(end - starts[d])})
                            a = end
                    for d, o in pairs.T:
                        matched[d].append(names[o])
                    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(spans, span), pa.array([sorted(x) for x in matched], pa.list_(pa.string()))],
                        names=["shard", "ord", "id", "n_words", "spans", "items"],
                    )

        parts.append(index.mapInArrow(look, _FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("shard", "ord").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), _merge(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.drop("shard", "ord")


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", width: int = 10, slop: int | None = None) -> DataFrame:
    """``search`` over a fresh index of ``docs``, with ``n_hit``, the number of document words inside matches."""
    found = search(build_index(docs, id, text), items, width=width, slop=slop)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(F.col("id").alias(id), "n_words", n_hit.alias("n_hit"), "spans", "items")


def decontaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", width: int = 10) -> DataFrame:
    """The rows of ``docs`` of whose id no row holds a window of any item; rows with a null id have no other to share a verdict with and stay."""
    hit = contamination(docs, items, id, text, width).where("n_hit > 0").select(id).distinct()
    return docs.join(hit, id, "left_anti").select(docs.columns)
