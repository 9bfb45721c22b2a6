"""Language identification by interpolated Kneser-Ney models of characters, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored, with_hot_keys
from .text import columns, mixed

ORDER = 4
#: Up to so many distinct n-grams of the highest order and so many languages the model is sent to the tasks; beyond, it stays in tables that texts are joined with. Nothing is left out either way.
MAX_GRAMS, MAX_SENT_LANGUAGES = 1_000_000, 100
#: Bound of the sample on which scores and rejection are calibrated.
CALIBRATION_DOCS = 20_000
#: Characters that a task works on at once; a longer text is taken in pieces that overlap by the context.
PIECE = 2_000_000

_PAD, _SPACE, UNKNOWN = 1, 32, "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For each code point of the first plane: itself, or a space if it is no letter."""
    return np.array([c if chr(c).isalpha() else _SPACE for c in range(65536)], np.uint32)


@dataclass(frozen=True)
class Piece:
    """A part of a text: the ORDER - 1 normalised code points ``before`` it (pads at the text's beginning), and whether the text ends with it."""

    before: np.ndarray
    text: str
    ends: bool = True


_START = np.full(ORDER - 1, _PAD, np.uint32)


def _lettered(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, with a space in place of each that is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = letters[np.minimum(codes, 65535)]
    high = np.flatnonzero(codes >= 65536)
    if len(high):
        kinds, which = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([c if chr(c).isalpha() else _SPACE for c in kinds.tolist()], np.uint32)[which]
    return out


def normalised(pieces: list[Piece], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased pieces, each begun by what stands before it, with runs of other than letters as one space; and where each piece begins."""
    parts, sizes = [], []
    for p in pieces:
        codes = _lettered(p.text, letters)
        parts += [p.before, codes, [_SPACE] * p.ends]
        sizes.append(len(p.before) + len(codes) + p.ends)
    codes = np.concatenate(parts).astype(np.uint32)
    begins = np.cumsum([0, *sizes[:-1]])
    space = codes == _SPACE
    keep = np.append(True, ~(space[1:] & (space[:-1] | (codes[:-1] == _PAD))))
    for k in range(ORDER - 1):  # what stands before a piece is normalised already
        keep[begins + k] = True
    before = np.cumsum(keep) - keep
    return codes[keep], before[begins]


def gram_hashes(codes: np.ndarray, length: int, shift: int = 0) -> np.ndarray:
    """For each position from ORDER - 1 on, the hash of the ``length`` code points that end ``shift`` before it."""
    n, end = len(codes) - ORDER + 1, ORDER - shift
    out = np.full(n, np.uint64(length), np.uint64)
    for k in range(end - length, end):
        out = mixed(out * _ODD + codes[k : k + n].astype(np.uint64))
    return out


def _distinct(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct highest-order grams at the marked positions: number of each position's gram, hashes, and one position of each."""
    at = np.flatnonzero(inside[ORDER - 1 :])
    number, hashes = pd.factorize(gram_hashes(codes, ORDER)[at])
    first = np.empty(len(hashes), np.int64)
    first[number[::-1]] = at[::-1]
    return number, hashes, first


def _inside(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions of which the grams lie inside one text."""
    inside = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        inside[np.minimum(begins + k, len(codes) - 1)] = False
    return inside


def _before(text: str, at: int, letters: np.ndarray) -> np.ndarray:
    """The last ORDER - 1 normalised code points of what stands before ``at`` in the text."""
    size = 4 * ORDER
    while True:
        begin = max(0, at - size)
        codes, _ = normalised([Piece(_START, text[begin:at], ends=False)], letters)
        if begin == 0 or len(codes) >= 2 * ORDER:  # beyond the pads there are more letters than are asked for
            return codes[1 - ORDER :]
        size *= 4


def _pieces(text: str, letters: np.ndarray) -> Iterator[Piece]:
    """The text in pieces of ``PIECE`` characters; together they have the very n-grams of the whole."""
    for k in range(0, len(text), PIECE):
        yield Piece(_before(text, k, letters) if k else _START, text[k : k + PIECE], k + PIECE >= len(text))


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(``lang``, ``gram``, ``n``) over all whole texts. Tasks count before anything is shuffled, and hold one piece of text and a bounded table at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        tables: dict[str, list[pd.Series]] = {}
        waiting: dict[str, list[Piece]] = {}

        def take(name: str) -> None:
            codes, begins = normalised(waiting.pop(name), letters)
            number, _, first = _distinct(codes, _inside(codes, begins))
            grams = np.stack([codes[first + k] for k in range(ORDER)], axis=1).astype("<u4")
            keys = [row.tobytes().decode("utf-32-le", "surrogatepass") for row in grams]
            tables.setdefault(name, []).append(pd.Series(np.bincount(number, minlength=len(keys)), index=keys))
            if len(tables[name]) > 8:
                tables[name] = [pd.concat(tables[name]).groupby(level=0).sum()]

        def flush(name: str) -> pa.RecordBatch:
            s = pd.concat(tables.pop(name)).groupby(level=0).sum()
            return pa.RecordBatch.from_arrays([pa.array([name] * len(s), pa.string()), pa.array(list(s.index), pa.string()), pa.array(s.to_numpy(), pa.int64())], names=["lang", "gram", "n"])

        sizes: dict[str, int] = {}
        for names, texts in columns(batches, "lang", "text"):
            for name, value in zip(names, texts, strict=True):
                for piece in _pieces(value, letters):
                    waiting.setdefault(name, []).append(piece)
                    sizes[name] = sizes.get(name, 0) + len(piece.text)
                    if sizes[name] >= PIECE:
                        take(name)
                        sizes[name] = 0
                        if sum(map(len, tables[name])) > 500_000:
                            yield flush(name)
        for name in list(waiting):
            take(name)
        for name in list(tables):
            yield flush(name)

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and text <> ''")
    return rows.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tables:
    """Of one language: per order, sorted hashes of grams and their log probabilities; sorted hashes of contexts and their log back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float


def _sorted(hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    return hashes[order], values[order].astype(np.float32)


def _hash_strings(grams: list[str], length: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
    out = np.full(len(codes), np.uint64(length), np.uint64)
    for k in range(length):
        out = mixed(out * _ODD + codes[:, k].astype(np.uint64))
    return out


def kneser_ney(counts: pd.Series) -> Tables:
    """Interpolated Kneser-Ney estimates from counts of ORDER-grams; lower orders count the different characters that a gram continues."""
    levels = [counts]
    for length in range(ORDER - 1, 0, -1):
        above = levels[0]
        levels.insert(0, pd.Series(1, index=[g[1:] for g in above.index]).groupby(level=0).sum())
    vocabulary = max(2, len(levels[0]) + 1)
    floor = -np.log(vocabulary)
    lower: pd.Series | None = None
    grams, contexts = [], []
    for length, level in enumerate(levels, 1):
        once, twice = int((level == 1).sum()), int((level == 2).sum())
        discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
        heads = pd.Index([g[:-1] for g in level.index])
        total, kinds = level.groupby(heads).sum(), level.groupby(heads).size()
        weight = discount * kinds / total
        tail = 1 / vocabulary if lower is None else lower.reindex([g[1:] for g in level.index]).to_numpy()
        p = (level.to_numpy() - discount) / total.reindex(heads).to_numpy() + weight.reindex(heads).to_numpy() * tail
        lower = pd.Series(p, index=level.index)
        grams.append(_sorted(_hash_strings(list(level.index), length), np.log(p)))
        if length > 1:
            contexts.append(_sorted(_hash_strings(list(weight.index), length - 1), np.log(weight.to_numpy())))
        else:
            floor = float(np.log(weight.iloc[0] / vocabulary))
    return Tables(grams, contexts, floor)


@dataclass(frozen=True)
class JoinedTables:
    """The same estimates as stored tables: per order ``(lang, gram, logp)``; of contexts ``(lang, gram, logw)``, from one character on; and ``(lang, floor)``."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    floors: DataFrame


def joined_kneser_ney(counts: DataFrame) -> JoinedTables:
    """What ``kneser_ney`` computes, of all languages at once and by joins: for more ``counts(lang, gram, n)`` than a machine should hold."""
    levels = [counts]
    for length in range(ORDER - 1, 0, -1):
        levels.insert(0, stored(levels[0].groupBy("lang", F.right("gram", F.lit(length)).alias("gram")).agg(F.count("*").alias("n")), "gram-levels"))
    sizes = levels[0].groupBy("lang").agg(F.greatest(F.lit(2), F.count("*") + 1).alias("vocabulary"))
    grams, contexts, floors = [], [], None
    for length, level in enumerate(levels, 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.when(once > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.05), once / (once + 2 * twice)))).otherwise(F.lit(0.05))
        discounts = F.broadcast(level.groupBy("lang").agg(discount.alias("discount")))  # a row per language
        heads = level.groupBy("lang", F.left("gram", F.lit(length - 1)).alias("head")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discounts, "lang")
        heads = stored(heads.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total")), "gram-heads")
        rows = level.withColumn("head", F.left("gram", F.lit(length - 1))).join(F.broadcast(heads) if length == 1 else heads, ["lang", "head"])
        if length == 1:
            rows = rows.join(F.broadcast(sizes), "lang").withColumn("tail", 1 / F.col("vocabulary"))
            floors = stored(heads.join(sizes, "lang").select("lang", F.log(F.col("weight") / F.col("vocabulary")).alias("floor")), "gram-floors")
        else:
            lower = grams[-1].select("lang", F.col("gram").alias("rest"), F.col("p").alias("tail"))
            rows = rows.withColumn("rest", F.right("gram", F.lit(length - 1))).join(lower, ["lang", "rest"])
            contexts.append(heads.select("lang", F.col("head").alias("gram"), F.log("weight").alias("logw")))
        p = (F.col("n") - F.col("discount")) / F.col("total") + F.col("weight") * F.col("tail")
        grams.append(stored(rows.select("lang", "gram", p.alias("p")).withColumn("logp", F.log("p")), "gram-chances"))
    return JoinedTables([g.drop("p") for g in grams], contexts, floors)


def joined_scores(tables: JoinedTables, grams: DataFrame) -> DataFrame:
    """(``gram``, ``lang``, ``s``): the log probability of each distinct gram's last character, by language, from the shortest end of it on."""
    ends = [grams.select("gram")]
    for length in range(ORDER - 1, 0, -1):
        ends.insert(0, stored(ends[0].select(F.right("gram", F.lit(length)).alias("gram")).distinct(), "gram-ends"))
    s = ends[0].crossJoin(F.broadcast(tables.floors)).select("gram", "lang", F.col("floor").alias("s"))
    for length, end in enumerate(ends, 1):
        if length > 1:
            shorter = s.withColumnRenamed("gram", "rest")
            weights = tables.contexts[length - 2].withColumnRenamed("gram", "head")
            s = end.withColumn("rest", F.right("gram", F.lit(length - 1))).join(shorter, "rest").withColumn("head", F.left("gram", F.lit(length - 1)))
            s = s.join(weights, ["lang", "head"], "left").select("gram", "lang", (F.col("s") + F.coalesce("logw", F.lit(0.0))).alias("s"))
        s = stored(s.join(tables.grams[length - 1], ["lang", "gram"], "left").select("gram", "lang", F.coalesce("logp", "s").alias("s")), "gram-scores")
    return s


def _look(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
    return table[0][at] == hashes, table[1][at]


def gram_scores(models: list[Tables], grams: np.ndarray) -> np.ndarray:
    """Log probability of each gram's last character, by language; ``grams``: rows of ORDER code points."""
    out = np.empty((len(grams), len(models)), np.float32)
    flat = grams.reshape(-1)
    hashes = lambda a, b: mixed_rows(flat.reshape(-1, ORDER)[:, a:b])
    whole = [hashes(ORDER - k, ORDER) for k in range(1, ORDER + 1)]
    heads = [hashes(ORDER - k, ORDER - 1) for k in range(2, ORDER + 1)]
    for m, t in enumerate(models):
        s = np.full(len(grams), t.floor, np.float32)
        for k in range(ORDER):
            if k:
                seen, weight = _look(t.contexts[k - 1], heads[k - 1])
                s = np.where(seen, s + weight, s)
            seen, logp = _look(t.grams[k], whole[k])
            s = np.where(seen, logp, s)
        out[:, m] = s
    return out


def mixed_rows(codes: np.ndarray) -> np.ndarray:
    out = np.full(len(codes), np.uint64(codes.shape[1]), np.uint64)
    for k in range(codes.shape[1]):
        out = mixed(out * _ODD + codes[:, k].astype(np.uint64))
    return out


@dataclass(frozen=True)
class Model:
    """``languages`` in order, their tables, and the calibration: a logistic curve over the margin, and each language's highest plausible cross-entropy."""

    languages: list[str]
    tables: list[Tables] | JoinedTables
    slope: float = 1.0
    offset: float = 0.0
    limits: tuple[float, ...] = ()


_SCORED = "id bigint, lang_pred string, cross_entropy double, margin double, n_letters bigint"


def cross_entropies(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, the language of lowest cross-entropy per character (first by name on a tie), that entropy, by how much the next is higher, and the number of letters."""
    if isinstance(model.tables, JoinedTables):
        return _joined_entropies(docs, model.tables, id, text)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, tables = sent.value
        letters = _letters()
        known, scores = np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32)

        def take(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sums of log probabilities, number of scored characters, and number of letters, by piece."""
            nonlocal known, scores
            codes, begins = normalised(pieces, letters)
            inside = _inside(codes, begins)
            if not inside.any():
                return np.zeros((len(begins), len(languages))), np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
            number, hashes, first = _distinct(codes, inside)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            new = known[at] != hashes if len(known) else np.ones(len(hashes), bool)
            if new.any():
                more = gram_scores(tables, np.stack([codes[first[new] + k] for k in range(ORDER)], axis=1))
                if len(known) * len(languages) > 8_000_000:
                    known, scores = known[:0], scores[:0]
                    more, new = gram_scores(tables, np.stack([codes[first + k] for k in range(ORDER)], axis=1)), np.ones(len(hashes), bool)
                order = np.argsort(all_known := np.concatenate([known, hashes[new]]))
                known, scores = all_known[order], np.concatenate([scores, more])[order]
                at = np.searchsorted(known, hashes)
            position = np.zeros(len(codes), np.int64)
            position[inside] = at[number]
            sums = np.stack([np.add.reduceat(np.where(inside, scores[position, m], 0), begins, dtype=np.float64) for m in range(len(languages))], axis=1)
            return sums, np.add.reduceat(inside.astype(np.int64), begins), np.add.reduceat((inside & (codes > _SPACE)).astype(np.int64), begins)

        for ids, texts in columns(batches, "id", "text"):
            n = len(ids)
            sums, sizes, found = np.zeros((n, len(languages))), np.zeros(n, np.int64), np.zeros(n, np.int64)
            group: list[Piece] = []
            owners: list[int] = []
            held = 0

            def done(group: list[Piece], owners: list[int], sums=sums, sizes=sizes, found=found) -> None:
                if group:
                    for total, part in zip((sums, sizes, found), take(group), strict=True):
                        np.add.at(total, owners, part)

            for k, value in enumerate(texts):
                for piece in _pieces(value or "", letters):
                    group.append(piece)
                    owners.append(k)
                    held += len(piece.text)
                    if held >= PIECE:
                        done(group, owners)
                        group, owners, held = [], [], 0
            done(group, owners)
            entropy = -sums / np.maximum(sizes, 1)[:, None]
            best = entropy.argmin(axis=1)
            ordered = np.sort(entropy, axis=1)
            margin = ordered[:, 1] - ordered[:, 0] if len(languages) > 1 else np.zeros(n)
            blank = found == 0
            names = [UNKNOWN if b else languages[i] for i, b in zip(best, blank, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(np.where(blank, 0, ordered[:, 0])), pa.array(np.where(blank, 0, margin)), pa.array(found)],
                names=["id", "lang_pred", "cross_entropy", "margin", "n_letters"],
            )

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(score, _SCORED)


def _joined_entropies(docs: DataFrame, tables: JoinedTables, id: str, text: str) -> DataFrame:
    """``cross_entropies`` by joins: each row's distinct grams, piece by piece, with the scores of all grams that occur."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, row = _letters(), (TaskContext.get().partitionId() << 40) - 1
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            kinds = {"row": pa.int64(), "id": pa.int64(), "size": pa.int64(), "letters": pa.int64(), "grams": pa.list_(pa.string()), "ns": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for ids, texts in columns(batches, "id", "text"):
            for key, value in zip(ids, texts, strict=True):
                row += 1
                for piece in _pieces(value, letters) if value else [Piece(_START, "")]:
                    codes, begins = normalised([piece], letters)
                    inside = _inside(codes, begins)
                    number, _, first = _distinct(codes, inside)
                    found = np.stack([codes[first + k] for k in range(ORDER)], axis=1).astype("<u4")
                    grams = [g.tobytes().decode("utf-32-le", "surrogatepass") for g in found] if value else []
                    ns = np.bincount(number, minlength=len(found)).tolist() if value else []
                    out.append((row, key, int(inside.sum()) if value else 0, int((inside & (codes > _SPACE)).sum()), grams, ns))
                    held += len(grams) + 1
                    if held >= 200_000:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    pieces = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(cut, "row bigint, id bigint, size bigint, letters bigint, grams array<string>, ns array<bigint>")
    pieces = stored(pieces, "gram-pieces")
    items = pieces.select("row", F.explode(F.arrays_zip("grams", "ns")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.ns").alias("n"))
    grams = stored(items.groupBy("gram").agg(F.count("*").alias("rows")), "gram-seen")
    by_gram = joined_scores(tables, grams).groupBy("gram").agg(F.collect_list(F.struct("lang", "s")).alias("scores"))
    known = stored(grams.join(by_gram, "gram"), "gram-known")
    sums = with_hot_keys(items, known, ["gram"], "rows").select("row", "n", F.explode("scores").alias("x")).groupBy("row", F.col("x.lang").alias("lang")).agg(F.sum(F.col("n") * F.col("x.s")).alias("sum"))
    best = sums.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("sum")).alias("e"), "lang"))).alias("best"))
    rows = pieces.groupBy("row").agg(F.first("id").alias("id"), F.sum("size").alias("size"), F.sum("letters").alias("n_letters")).join(best, "row", "left")
    blank = (F.col("n_letters") == 0) | F.col("best").isNull()
    first, second, size = F.get("best", F.lit(0)), F.get("best", F.lit(1)), F.greatest("size", F.lit(1))
    margin = F.coalesce((second["e"] - first["e"]) / size, F.lit(0.0))
    return rows.select("id", F.when(blank, F.lit(UNKNOWN)).otherwise(first["lang"]).alias("lang_pred"), F.when(blank, 0.0).otherwise(first["e"] / size).alias("cross_entropy"), F.when(blank, 0.0).otherwise(margin).alias("margin"), "n_letters")


def _evidence() -> Column:
    """The logarithm of the margin, which grows with the text's length as sums of independent terms spread."""
    return F.log1p(F.col("margin") * F.sqrt("n_letters"))


def fit(labelled: DataFrame, calibration: DataFrame, id: str = "doc_id", lang: str = "lang", text: str = "text", max_grams: int = MAX_GRAMS, calibration_docs: int = CALIBRATION_DOCS) -> Model | None:
    """The model of all texts of ``labelled``, calibrated on at most about ``calibration_docs`` rows of ``calibration``; None if no row has a language and a text.

    All texts are counted by Spark, and all n-grams of all languages make the model. If they are no more than
    ``max_grams``, the estimates are made on the driver and sent to the tasks; beyond, they are made by joins and
    stay in stored tables, which the texts' distinct n-grams are joined with. The calibration sample, by hash of
    the id, gives a logistic curve from evidence to the chance of being right (from 200 bins) and, by language,
    the 99.9 % quantile of the cross-entropy of right answers, from which rejection follows.
    """
    counts = stored(gram_counts(labelled, lang, text), "grams")
    sizes = {r["lang"]: r["grams"] for r in counts.groupBy("lang").agg(F.count("*").alias("grams")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    if sum(sizes.values()) <= max_grams and len(languages) <= MAX_SENT_LANGUAGES:
        every = counts.toPandas()
        tables = [kneser_ney(every[every["lang"] == name].set_index("gram")["n"].sort_index()) for name in languages]
    else:
        tables = joined_kneser_ney(counts)
    model = Model(languages, tables, limits=(float("inf"),) * len(languages))
    rows = calibration.where(F.col(lang).isNotNull())
    share = min(1.0, calibration_docs / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(11), F.col(id)), F.lit(1_000_000)) < share * 1_000_000)
    truth = sample.select(F.col(id).alias("id"), F.col(lang).alias("lang")).distinct()
    scored = stored(cross_entropies(sample, model, id, text).join(truth, "id").where(f"lang_pred <> '{UNKNOWN}'"), "calibration")
    right = (F.col("lang") == F.col("lang_pred")).cast("int")
    top = scored.agg(F.max(_evidence())).first()[0] or 1.0
    bins = scored.groupBy(F.least(F.floor(_evidence() / F.lit(top) * 200), F.lit(199)).alias("bin")).agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.avg(_evidence()).alias("x")).toPandas()
    limits = {r["lang_pred"]: r["q"] for r in scored.where(right == 1).groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 0.999).alias("q")).collect()}
    a, b = _logistic(bins)
    return Model(languages, tables, a, b, tuple(float(limits.get(name, float("inf"))) for name in languages))


def _logistic(bins: pd.DataFrame) -> tuple[float, float]:
    """Slope and offset of the chance of being right, by Newton steps on the bins, with a mild pull to 0."""
    if not len(bins):
        return 1.0, 0.0
    x = np.stack([bins["x"].to_numpy(float) / (scale := max(bins["x"].max(), 1e-9)), np.ones(len(bins))], axis=1)
    n, y = bins["n"].to_numpy(float), bins["right"].to_numpy(float)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - n * p) - 0.1 * w
        w = w + np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 0.1 * np.eye(2), gradient).clip(-5, 5)
    return float(max(w[0], 0) / scale), float(w[1])


def identify(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id`` (a whole number or null), ``lang_pred``, ``score`` (calibrated chance of being right), ``cross_entropy`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is everything without a
    model. A text whose cross-entropy is above what its language's right answers show, or whose score is below
    a half, is rejected but keeps its best language. Repeated rows are judged alike; texts are used whole.
    """
    if model is None:
        return docs.select(F.col(id).alias("id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    limits = F.create_map(*[F.lit(x) for pair in zip(model.languages, model.limits, strict=True) for x in pair])
    limit = F.coalesce(F.try_element_at(limits, F.col("lang_pred")), F.lit(float("inf")))
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(1 / (1 + F.exp(-(F.lit(model.slope) * _evidence() + F.lit(model.offset)))))
    out = cross_entropies(docs, model, id, text).withColumn("score", score)
    return out.select("id", "lang_pred", "score", "cross_entropy", ((F.col("lang_pred") == UNKNOWN) | (F.col("cross_entropy") > limit) | (F.col("score") < 0.5)).alias("rejected"))
