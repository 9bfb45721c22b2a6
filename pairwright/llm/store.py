"""Links between ids that collide in keys, without making all pairs of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.graph import components
from ..sources.checkpoints import shared_folder, stored

__all__ = ["FINE", "colliding_links", "components", "most_different", "shared_folder", "stored", "wanted_ids", "with_hot_keys"]

#: Up to so many ids are sent to all tasks to fetch what belongs to them (16 MB); beyond, they are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Bits kept of each register of a signature, one plane of words for each.
PLANES = 4
#: Registers of the sketches of the last comparison.
FINE = 512
#: Rounds in which each id meets one neighbour per key, before what is still apart is compared in full.
ROUNDS = 3


#: A key with more than this part of all rows is joined by broadcast, so there are fewer than HOT_KEYS such keys.
HOT_KEYS = 10_000


def with_hot_keys(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined by ``keys`` with ``table``, which has each key once and in ``n`` how many rows have it.

    Keys with more than 1 / ``HOT_KEYS`` of the rows counted there are sent to all tasks; there can be no more than
    ``HOT_KEYS``, however many rows there are. Only the others are shuffled, so no task gets a hot key's rows.
    """
    least = (table.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(table.where(F.col(n) > F.lit(least)))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(n) <= F.lit(least)), keys)
    return rows.join(hot, keys).unionByName(rest)


def wanted_ids(ids: DataFrame, name: str = "wanted") -> DataFrame:
    """``ids`` written down, and marked for broadcast if counted to be few enough."""
    ids = stored(ids.distinct(), name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def most_different(registers: int, similarity: float, deviations: float = 3.3) -> int:
    """In how many of ``registers`` two signatures of ``similarity`` differ at most, up to ``deviations`` standard deviations."""
    same = similarity + (1 - similarity) / 2**PLANES
    return int(registers * (1 - same) + deviations * (registers * same * (1 - same)) ** 0.5)


def _differing(a: Column, b: Column, words: int) -> Column:
    """In how many registers two sketches differ: ``PLANES`` times ``words`` words, a bit for each register in each plane."""
    total = F.lit(0)
    for w in range(words):
        bits = F.lit(0).cast("bigint")
        for p in range(PLANES):
            bits = bits.bitwiseOR(F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w))))
        total = total + F.bit_count(bits)
    return total


def _shared(rows: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """``rows`` with ``shared``, how much of an id's size others among them have too, less the ids of which that is too little for any pair.

    What no other id has cannot be in an intersection, so this bounds the similarity of every pair exactly.
    """
    own = items.groupBy("item").agg(F.count("*").alias("d"), F.min("id").alias("id"), F.min("n").alias("n")).where("d = 1").groupBy("id").agg(F.sum("n").alias("own"))
    out = rows.join(own, "id", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")
    return out.where(F.col("shared") >= F.lit(similarity) * F.col("size"))


def colliding_links(entries: DataFrame, sketches: DataFrame, registers: int, similarity: float, verify: Callable[[DataFrame, DataFrame], DataFrame], items: Callable[[DataFrame, DataFrame], DataFrame], finer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all pairs of ids that share a key in ``entries(key, id, size)`` and verify.

    A key shared by very many ids must not make all their pairs. So in each key every id first meets the least
    one, then in each further round its neighbour in an order by hash, which makes as many pairs as the key has
    ids; ids already in one component are not paired again. What is then still apart within a key is compared in
    full across components, so no link between components is lost; ids too much of which no other id has are left
    out there, for they have no link. Before a pair is verified, sizes must be within ``similarity`` of each
    other, and the sketches must not differ in more registers than ``most_different`` says. ``verify`` takes pairs
    ``(a, b)`` and all ids that share a key with another, and returns the pairs that hold; ``items`` takes some ids
    and all those, and returns ``(id, item, n)``: what an id's size counts. ``finer``, if given, takes the same and
    returns ``(id, sketch)`` of ``FINE`` registers for the last comparison, which only few ids reach.
    """
    order = W.partitionBy("key").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    starred = entries.withColumn("head", F.first(F.struct("id", "size")).over(order)).where("id <> head.id")
    starred = stored(starred.select("key", F.col("head.id").alias("head"), F.col("head.size").alias("head_size"), "id", "size"), "collisions")
    members = starred.select("key", "id", "size").unionByName(starred.select("key", F.col("head").alias("id"), F.col("head_size").alias("size"))).distinct()
    ids = stored(members.select("id").distinct(), "colliding")
    members = stored(members.join(sketches.groupBy("id").agg(F.first("sketch").alias("sketch")), "id"), "members")
    alike = lambda m: (F.least("sa", "sb") >= F.lit(similarity) * F.greatest("sa", "sb")) & (_differing(F.col("ka"), F.col("kb"), -(-m // 64)) <= most_different(m, similarity))
    near = alike(registers)
    one = lambda x: [F.col("id").alias(x), F.col("size").alias(f"s{x}"), F.col("root").alias(f"r{x}"), F.col("sketch").alias(f"k{x}")]
    pair = lambda df, near: df.where("ra <> rb").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, now = None, members.withColumn("root", F.col("id"))
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            order = W.partitionBy("key").orderBy(F.xxhash64(F.lit(k), "id"), "id") if k else W.partitionBy("key").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
            other = F.lag(F.struct("id", "size", "root", "sketch")).over(order) if k else F.first(F.struct("id", "size", "root", "sketch")).over(order)
            pairs = now.withColumn("o", other).where("o is not null").select(*one("a"), *[F.col(f"o.{c}").alias(n) for c, n in (("id", "b"), ("size", "sb"), ("root", "rb"), ("sketch", "kb"))])
        else:
            rest = stored(_shared(now, items(now.select("id").distinct(), ids), similarity), "shared")
            if finer is not None:
                near, rest = alike(FINE), rest.drop("sketch").join(finer(rest.select("id").distinct(), ids), "id")
            rest = stored(rest.join(rest.groupBy("id").agg(F.collect_set("key").alias("keys")), "id"), "shared")
            whole = lambda x: rest.select("key", *one(x), F.col("shared").alias(f"i{x}"), F.col("keys").alias(f"keys{x}"))
            bound = F.least("ia", "ib") * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("sa") + F.col("sb"))
            once = F.array_min(F.array_intersect("keysa", "keysb")) == F.col("key")  # a pair is made in one of its keys only
            pairs = whole("a").join(whole("b"), "key").where((F.col("a") < F.col("b")) & bound & (F.col("ra") != F.col("rb")) & near & once)
        more = stored(verify(stored(pair(pairs, near), "pairs"), ids), "links")
        links = more if links is None else links.unionByName(more)
        if k < ROUNDS:
            rooted = members.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
            apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            now = stored(rooted.join(apart, "key", "left_semi"), "apart")
    return links
