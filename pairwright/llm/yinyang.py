"""Centroid clustering by Yinyang grouping: exact k-means on whole numbers, with one lower bound for each group of centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.checkpoints import discard, stored

#: Components lie within this, so that the squared distance of 256 components fits in 64 bits; what is beyond is set to it.
LIMIT = 2**26


def quantised(vectors: DataFrame, id: str, vector: str, dims: int, scale: float) -> DataFrame:
    """(``id``, ``x``): the vectors with exactly ``dims`` components, none null or not finite, as floor(``scale`` * component)."""
    v = F.col(vector)
    sound = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return vectors.where(v.isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id).alias("id"), F.transform(v, whole).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or to one each."""
    return ((x - c) ** 2).sum(axis=1)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """The numbers of the centroids of each group: a small clustering of the centroids themselves, seeded by the farthest from those taken."""
    c = centroids.astype(np.float64)
    seeds = [0]
    while len(seeds) < min(groups, len(c)):
        seeds.append(int(np.argmax(np.min([squared(c, c[s]) for s in seeds], axis=0))))
    middle = c[seeds]
    for _ in range(rounds):
        owner = np.argmin([squared(c, m) for m in middle], axis=0)
        middle = np.array([c[owner == g].mean(axis=0) if (owner == g).any() else middle[g] for g in range(len(middle))])
    return [np.flatnonzero(owner == g) for g in range(len(middle)) if (owner == g).any()]


def _least(x: np.ndarray, centroids: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: the least squared distance, whose it is (the smaller number on a tie), and the least of the others."""
    d = np.stack([squared(x, centroids[c]) for c in members], axis=1)
    at = d.argmin(axis=1)
    rows = np.arange(len(x))
    first = d[rows, at]
    d[rows, at] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64)) if len(members) > 1 else np.full(len(x), np.inf)
    return first, members[at], second


def first_step(x: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Assignment, upper bound, lower bound for each group, and distances computed: every centroid is looked at once."""
    found = [_least(x, centroids, g) for g in groups]
    return _settled(found, None, None, None, [np.ones(len(x), bool)] * len(groups), np.full((len(x), len(groups)), np.inf)) + (np.full(len(x), len(centroids)),)


def _settled(found, best, own, old_group, scanned, lower):
    """The nearest of what each group found, and the bounds that follow."""
    best = np.full(len(lower), np.iinfo(np.int64).max) if best is None else best
    own = np.full(len(lower), np.iinfo(np.int32).max) if own is None else own
    before, held = own.copy(), best.copy()
    for got, rows in zip(found, scanned, strict=True):
        if got is not None:
            least, who, _ = got
            better = (least < best[rows]) | ((least == best[rows]) & (who < own[rows]))
            at = np.flatnonzero(rows)[better]
            best[at], own[at] = least[better], who[better]
    for g, (got, rows) in enumerate(zip(found, scanned, strict=True)):
        if got is not None:
            least, who, second = got
            lower[rows, g] = np.where(who == own[rows], second, np.sqrt(least.astype(np.float64)))
        if old_group is not None:  # the centroid left behind now counts among its group's others
            left = ~rows & (old_group == g) & (own != before)
            lower[left, g] = np.minimum(lower[left, g], np.sqrt(held[left].astype(np.float64)))
    return own, np.sqrt(best.astype(np.float64)), lower


def _beyond(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Whether a lower bound is surely above an upper one: by more than rounding can explain, so that no tie is lost."""
    return lower > upper * (1 + 1e-9) + 1e-6


def next_step(x, own, upper, lower, centroids, groups, moved):
    """The same after the centroids have ``moved`` so far: bounds first, and exact distances only where they leave doubt."""
    own, upper, lower = own.copy(), upper + moved[own], lower - np.array([moved[g].max() for g in groups])
    group_of = np.zeros(len(centroids), np.int64)
    for k, g in enumerate(groups):
        group_of[g] = k
    seen = np.zeros(len(x), np.int64)
    doubt = np.flatnonzero(~_beyond(lower.min(axis=1), upper))  # the global filter
    exact = squared(x[doubt], centroids[own[doubt]])
    upper[doubt], seen[doubt] = np.sqrt(exact.astype(np.float64)), 1
    still = ~_beyond(lower[doubt].min(axis=1), upper[doubt])  # and again with the exact distance
    doubt, exact = doubt[still], exact[still]
    if len(doubt):
        part, low = x[doubt], lower[doubt]
        scanned = [~_beyond(low[:, k], upper[doubt]) for k in range(len(groups))]  # the group filter
        found = [_least(part[rows], centroids, g) if rows.any() else None for rows, g in zip(scanned, groups, strict=True)]
        own[doubt], upper[doubt], lower[doubt] = _settled(found, exact, own[doubt], group_of[own[doubt]], scanned, low)
        seen[doubt] += sum(rows * len(g) for rows, g in zip(scanned, groups, strict=True))
    return own, upper, lower, seen


def _matrix(column: pa.Array, kind) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1)


def _assigned(state: DataFrame, centroids: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None) -> DataFrame:
    """``state`` after one assignment; ``moved`` is None in the first."""
    kind = T.StructType([
        state.schema["id"], state.schema["x"], T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()),
        T.StructField("lower", T.ArrayType(T.DoubleType())), T.StructField("distance", T.LongType()), T.StructField("seen", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            x = _matrix(get("x"), np.int64)
            if moved is None:
                own, upper, lower, seen = first_step(x, centroids, groups)
            else:
                own, upper, lower, seen = next_step(x, get("cluster").to_numpy().astype(np.int64), get("upper").to_numpy(), _matrix(get("lower"), np.float64), centroids, groups, moved)
                seen = seen + get("seen").to_numpy()
            ends = pa.array(np.arange(0, lower.size + 1, lower.shape[1]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(lower.reshape(-1)))
            yield pa.RecordBatch.from_arrays([get("id"), get("x"), pa.array(own, pa.int32()), pa.array(upper), lists, pa.array(squared(x, centroids[own])), pa.array(seen)], [f.name for f in kind])

    return state.mapInArrow(run, kind)


def clusters(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64, seed: int = 1, groups: int | None = None) -> DataFrame:
    """(``id``, ``cluster``, ``distance``, ``centroid``, ``cluster_inertia``, ``inertia``, ``seen``) of every vector that ``quantised`` keeps.

    Centroids start as the ``k`` vectors with the least SHA-256 of ``seed:id``, in that order (fewer, if there are
    fewer). In each round every vector goes to the nearest (the smaller number on a tie), and each centroid that has
    vectors becomes floor(sum / count) of their components; then all are assigned once more. All sums and distances
    are of whole numbers, so the result does not depend on partitions.

    The centroids are clustered once into ``groups`` (one for four, if not given). A vector carries its centroid, an
    upper bound of the distance to it, and a lower bound for each group; after the centroids have moved, it is left
    alone if its bounds still hold (globally, then by group), and only centroids of the groups left are looked at. ``seen``
    counts the distances computed. Between rounds the vectors and bounds are a table in the shared folder, of which the
    one before is deleted; sums are made per task before they meet. What the driver holds is k times ``dims`` numbers.

    Null, short, long and non-finite vectors are left out; null ids are kept and hashed as empty; rows that share an id
    are vectors of their own; further columns are ignored; an empty table gives an empty one. Components beyond ``LIMIT``
    after scaling are set to it.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id, vector, dims, scale)
    names = {"id": rows.schema["id"].dataType.simpleString(), "cluster": "int", "distance": "bigint", "centroid": "array<bigint>", "cluster_inertia": "bigint", "inertia": "bigint", "seen": "bigint"}
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = rows.orderBy(order, "x").select("x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in names.items()))
    centroids = np.array([r["x"] for r in start], np.int64)
    parts = grouped(centroids, groups or max(1, -(-len(centroids) // 4)))
    state = stored(_assigned(rows, centroids, parts, None), "yinyang")
    for _ in range(rounds):
        sums = state.groupBy("cluster").agg(F.count("*"), *[F.sum(F.get("x", F.lit(i))) for i in range(dims)]).collect()
        after = centroids.copy()
        for r in sums:
            after[r[0]] = [s // r[1] for s in r[2:]]
        moved = np.sqrt(squared(after, centroids).astype(np.float64))
        centroids, last = after, state
        state = stored(_assigned(last, centroids, parts, moved), "yinyang")
        discard(last)
    within = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    total = sum(r["cluster_inertia"] for r in within)
    about = spark.createDataFrame([(r["cluster"], centroids[r["cluster"]].tolist(), r["cluster_inertia"], total) for r in within], "cluster int, centroid array<bigint>, cluster_inertia bigint, inertia bigint")
    return state.join(F.broadcast(about), "cluster").select(*names)
