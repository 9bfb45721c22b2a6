"""A vector table that a filter prunes: in folders by a column's value and by coarse cell, so a search reads only what its filter and its cells ask for."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import dot
from ..sources.checkpoints import stored
from ..sources.rewrite import Files
from .retrieve import QUERY_BLOCK, normalised

#: Cells are found from so many vectors at most, first by a hash of their id; every vector is in the table.
SAMPLE = 10_000


@dataclass(frozen=True)
class Cells:
    """A vector table as published: where it lies, and the middles of its cells."""

    spark: SparkSession
    path: str
    middles: list[list[float]]

    def probes(self, vector: Column, n: int) -> Column:
        """The ``n`` cells nearest to a vector of length 1."""
        scores = F.array(*[F.struct((-dot(vector, F.array(*map(F.lit, m)))).alias("far"), F.lit(k).alias("cell")) for k, m in enumerate(self.middles)])
        return F.transform(F.slice(F.array_sort(scores), 1, n), lambda s: s["cell"])


def _middles(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Spherical means of a bounded sample, seeded by the farthest from those taken."""
    middle = sample[:1]
    while len(middle) < min(cells, len(sample)):
        middle = np.concatenate([middle, sample[(sample @ middle.T).max(axis=1).argmin()][None]])
    for _ in range(rounds):
        own = (sample @ middle.T).argmax(axis=1)
        sums = np.array([sample[own == k].sum(axis=0) if (own == k).any() else middle[k] for k in range(len(middle))])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(length > 0, sums / np.where(length > 0, length, 1), middle)
    return middle


def build(vectors: DataFrame, id: str, vector: str, by: str, path: str, cells: int = 16, seed: int = 1) -> Cells:
    """Write the vectors, of length 1, under ``path`` in folders by ``by`` and cell, and make that the current table there, whole.

    ``by`` is a column of few values; null is a value. Null and zero vectors are left out: they are near to nothing.
    """
    spark = vectors.sparkSession
    rows = normalised(vectors, vector).where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("v"), F.col(by).cast("string").alias("by"))
    first = rows.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(SAMPLE).select("v").collect()
    sample = np.array([r["v"] for r in first], np.float64).reshape(len(first), -1)
    middles = np.round(_middles(sample, cells), 9) if len(sample) else np.zeros((1, 1))
    kind = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ middles.T).argmax(axis=1), pa.int32())], [f.name for f in kind])

    at = f"{path}/v-{uuid.uuid4().hex}"
    rows.mapInArrow(assign, kind).write.partitionBy("by", "cell").parquet(f"{at}/vectors")
    files = Files(spark, path)
    files.mark(f"{at}/catalogue.json", json.dumps({"middles": middles.tolist()}))
    files.mark(f"{path}/CURRENT", at.rsplit("/", 1)[1])
    return Cells(spark, at, middles.tolist())


def search(queries: DataFrame, table: Cells, id: str, vector: str, k: int = 50, by: str | None = None, probe: int | None = None) -> DataFrame:
    """(``query``, ``match``, ``cosine``, ``rank``): the ``k`` nearest of the table to each of a stated set of queries; not itself; ties by id.

    With ``by``, only among vectors that have the query's value of that column: other folders are not read. With ``probe``
    only that many cells nearest to the query are searched; without, all, so the result is exact. Queries go to all tasks in blocks.
    """
    own = [F.col(by).cast("string").alias("by")] if by else []
    asked = normalised(queries, vector).where(F.col(vector).isNotNull()).select(F.col(id).alias("query"), F.col(vector).alias("q"), *own)
    if probe is not None:
        asked = asked.withColumn("cell", F.explode(table.probes(F.col("q"), probe)))
    asked = stored(asked, "asked")
    keys = [c for c in ("by", "cell") if c in asked.columns]
    base = table.spark.read.parquet(f"{table.path}/vectors").withColumn("by", F.col("by").cast("string"))
    if keys:
        folders = asked.select(*keys).distinct().collect()  # as many as the table has folders, at most
        for c in keys:
            values = sorted({r[c] for r in folders if r[c] is not None})
            base = base.where(F.col(c).isin(values) | (F.col(c).isNull() if any(r[c] is None for r in folders) else F.lit(False)))
    best = W.partitionBy("query").orderBy(F.desc("cosine"), "match")
    blocks, out = -(-asked.count() // QUERY_BLOCK) or 1, None
    for n in range(blocks):
        some = F.broadcast(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).withColumnsRenamed({c: f"_{c}" for c in keys}))
        meets = F.col("query") != F.col("id")
        for c in keys:
            meets = meets & F.col(c).eqNullSafe(F.col(f"_{c}"))
        near = base.join(some, meets).select("query", F.col("id").alias("match"), F.round(dot(F.col("q"), F.col("v")), 6).alias("cosine"))
        near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = near if out is None else out.unionByName(near)
    return out


def ladder(queries: DataFrame, table: Cells, id: str, vector: str, by: str, k: int = 50, probe: int | None = None) -> DataFrame:
    """(``query``, ``match``, ``cosine``, ``rung``, ``rank``): the ``k`` nearest that share ``by`` with the query (rung 0); and where there are fewer, the ``k`` nearest of any that are not among them (rung 1).

    The second search is made for the queries left short only.
    """
    strict = stored(search(queries, table, id, vector, k, by, probe).withColumn("rung", F.lit(0)), "strict")
    enough = strict.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = stored(queries.join(enough, F.col(id) == F.col("query"), "left_anti").select(id, vector), "short")
    if short.isEmpty():
        return strict
    loose = search(short, table, id, vector, k, None, probe).withColumn("rung", F.lit(1))
    return strict.unionByName(loose.join(strict.select("query", "match"), ["query", "match"], "left_anti").select(strict.columns))
