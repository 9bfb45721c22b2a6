"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import discard, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)`` (bigint): one row (``id``, ``root``) per id that has a link,
    ``root`` being the smallest id of its component.

    Alternating large-star and small-star rounds: each id points at the smallest id known in its
    neighbourhood, so the depth halves and O(log n) rounds are enough. Every round aggregates on a key before
    any row is emitted per neighbour, so no group is gathered. Self-links and nulls are ignored; an empty
    table gives an empty one. Raises if ``max_rounds`` do not suffice, rather than return a partial result.
    """
    spark = links.sparkSession
    edges = stored(
        links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges"
    )  # u > v always
    if edges.isEmpty():
        return spark.createDataFrame([], "id bigint, root bigint")

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    for _ in range(max_rounds):
        # Large star: each larger neighbour of u is tied to the smallest id around u.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each smaller neighbour of u, and u, is tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges, last = stored(small.where("u <> v").distinct(), "edges"), edges
        discard(last)
        now = signature(edges)
        if now == before:
            roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
