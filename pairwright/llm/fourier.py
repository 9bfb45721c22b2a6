"""A quality classifier: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Statistics are whole numbers of this part of one, and Fourier features of that: their sums are exact in any order.
UNIT = 2**16
WAVE = 2**15
#: Raw scores are counted in so many bins for calibration, between LOW and HIGH; what is beyond is in the last of a side.
BINS, LOW, HIGH = 2000, -0.5, 1.5

STATISTICS = (
    "log_words", "word_length", "symbols", "exclamations", "upper_case", "digits", "sentence_marks", "distinct_words",
    "distinct_pairs", "repeats_in_a_row", "repeated_lines", "log_line_length", "wordless",
)

#: Classes of UTF-8 bytes: 0 other, 1 capital, 2 small, 3 digit, 4 symbol, 5 exclamation, 6 mark of sentences, 7 beyond ASCII, 8 its following bytes.
_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"#*$%&|<>{}[]\\^_=+~@`", 4), (b"!", 5), (b".,;:?", 6)):
    _CLASS[list(_chars)] = _k
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 7, 8


def statistics_of(text: str | None) -> list[float]:
    """The ``STATISTICS`` of one whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    count = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=9)
    letters = count[1] + count[2] + count[7]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    pairs = max(len(words) - 1, 1)
    return [
        np.log1p(len(words)),
        min(sum(map(len, words)) / n, 50.0),
        min(count[4] / n, 10.0),
        min(count[5] / n, 10.0),
        count[1] / max(letters, 1),
        min(count[3] / n, 10.0),
        min(count[6] / n, 10.0),
        len(set(words)) / n,
        len(set(pairwise(words))) / pairs,
        sum(map(operator.eq, words, islice(words, 1, None))) / pairs,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)),
        float(not letters),
    ]


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ``stats``): of every row the statistics of its whole text, as whole numbers of 1 / ``UNIT``."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = T.StructType([rows.schema["id"], T.StructField("stats", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                stats = np.rint([[v * UNIT for v in statistics_of(t)] for t in part.column(1).to_pylist()]).astype(np.int64)
                ends = pa.array(np.arange(0, stats.size + 1, stats.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(stats.reshape(-1)))], ["id", "stats"])

    return rows.mapInArrow(run, kind)


@dataclass(frozen=True)
class Model:
    """What the tasks need to score: its size depends on ``features`` and ``BINS`` only."""

    mean: np.ndarray
    deviation: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # the calibrated score at each

    def waves(self, stats: np.ndarray) -> np.ndarray:
        """Fourier features as whole numbers of 1 / ``WAVE``, the last a constant."""
        z = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.rint(np.concatenate([np.cos(z @ self.frequencies + self.phases), np.ones((len(z), 1))], axis=1) * WAVE)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.round(self.waves(stats) @ self.weights, 6)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.raw(stats), self.steps, self.levels), 6)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("stats"))
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours until shares ascend; the first and the last place of each pool with its share, for interpolation between pools."""
    pools: list[list[float]] = []
    for x, g, c in zip(at, good, n, strict=True):
        pools.append([x, x, g, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return np.array([x for p in pools for x in p[:2]]), np.array([p[2] / p[3] for p in pools for _ in range(2)])


def fit(train: DataFrame, calibration: DataFrame, features: int = 192, width: float = 1.0, ridge: float = 1e-3, seed: int = 1) -> Model:
    """A model of rows ``(stats, label)``, labels 0 or 1; ``calibration`` has other rows of the same kind.

    Every row takes part. Means, deviations and the normal equations are sums of whole numbers: each task adds up the
    products of its rows, and Spark adds up those of the tasks, so the result does not depend on partitions. The driver
    solves a system of ``features`` + 1 unknowns. Frequencies are drawn for a Gaussian kernel whose width is ``width``
    times the square root of the number of statistics. Rows with null labels or statistics are left out. Without training
    rows all scores are one half; without calibration rows they are the ridge scores, cut to 0 and 1.
    """
    train, calibration = (rows.where("label is not null and stats is not null").select("stats", F.col("label").cast("int").alias("label")) for rows in (train, calibration))
    d = len(STATISTICS)
    q = [F.get("stats", F.lit(k)) for k in range(d)]
    total = train.agg(F.count("*"), *[F.sum(x) for x in q], *[F.sum((x * x).cast("decimal(38,0)")) for x in q]).first()
    n = total[0]
    if not n:
        return Model(np.zeros(d), np.ones(d), np.zeros((d, features)), np.zeros(features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([s / n for s in total[1 : d + 1]])
    deviation = np.sqrt(np.maximum([float(s) / n - m * m for s, m in zip(total[d + 1 :], mean, strict=True)], 0))
    deviation[deviation < UNIT * 1e-6] = UNIT
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(0, 1 / (width * d**0.5), (d, features)), rng.uniform(0, 2 * np.pi, features)
    model = Model(mean, deviation, frequencies, phases, np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    upper = np.triu_indices(features + 2, 0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((features + 2, features + 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                labels = batch.column(batch.schema.get_field_index("label")).to_numpy().astype(np.float64)
                z = np.concatenate([model.waves(_stats(batch)), labels[:, None] * WAVE], axis=1)
                kept += np.rint(z.T @ z).astype(np.int64)  # exact: a batch has far fewer than 2^23 rows
        if kept[-2, -2]:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(kept[upper])], ["i", "j", "v"])

    sums = train.mapInArrow(products, "i int, j int, v bigint").groupBy("i", "j").agg(F.sum("v")).collect()
    m = np.zeros((features + 2, features + 2))
    for i, j, v in sums:
        m[i, j] = m[j, i] = v / n / WAVE**2
    penalty = np.eye(features + 1) * ridge
    penalty[-1, -1] = 0  # not the constant
    weights = np.linalg.solve(m[:-1, :-1] + penalty, m[:-1, -1]) / WAVE
    model = Model(mean, deviation, frequencies, phases, np.round(weights, 12), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (model.raw(_stats(batch)) - LOW) / (HIGH - LOW)
                bins = np.clip(np.floor(share * BINS), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(batch.schema.get_field_index("label"))], ["bin", "label"])

    counts = calibration.mapInArrow(raw, "bin int, label int").groupBy("bin").agg(F.sum("label"), F.count("*")).orderBy("bin").collect()
    if not counts:
        return model
    at = np.array([LOW + (r[0] + 0.5) * (HIGH - LOW) / BINS for r in counts])
    steps, levels = isotonic(at, np.array([r[1] for r in counts]), np.array([r[2] for r in counts]))
    return Model(mean, deviation, frequencies, phases, model.weights, steps, levels)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(``id``, ``score``) of every row of ``statistics``, 0 to 1 and higher for label 1."""
    kind = T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(np.clip(model.score(_stats(batch)), 0, 1))], ["id", "score"])

    return stats.select("id", "stats").mapInArrow(run, kind)


def labelled(stats: DataFrame, labels: DataFrame, id: str, label: str) -> DataFrame:
    """(``id``, ``stats``, ``label``) of the rows whose id has one label, 0 or 1; ids with none, or with both, teach nothing."""
    sure = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("_other")).where("label = _other")
    return stats.join(sure.select("id", "label"), "id").select("id", "stats", "label")
