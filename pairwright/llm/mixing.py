"""Temperature mixing: source shares raised to an exponent, found by bisection, and realised as block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import stored

#: Words in a block, on average: the unit that is permuted, and the most that is ordered by one key.
BLOCK_WORDS = 200_000
#: Parts into which each step of the bisection cuts its interval.
PARTS = 16

_UNIT = float(1 << 52)


def _key(source: Column) -> Column:
    """A source's name as a join key; null is a source of its own, apart from any name."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(_UNIT)


def exponent(sources: DataFrame, budget: float, entropy_share: float | None = 0.5, max_repeats: float | None = 4.0, rounds: int = 8) -> float:
    """The largest exponent in [0, 1] that meets the entropy, raised as far as the repetition limit needs.

    ``entropy_share`` e asks for an entropy of e of the way from that of the natural shares (exponent 1) to the
    greatest possible (exponent 0); it falls as the exponent grows. ``max_repeats`` bounds how often any source
    is gone through within ``budget``; that falls too. Each round evaluates the ends of ``PARTS`` intervals in
    one aggregation over ``sources(tokens)`` and keeps the one in which the condition turns; 17 rows come back,
    however many sources there are. No source with tokens: 1.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def at(points: list[float]) -> list[tuple[float, float]]:
        grid = sources.where("tokens > 0").select(share.alias("p"), F.explode(F.array(*[F.lit(float(x)) for x in points])).alias("a"))
        w = F.exp(F.col("a") * F.log("p"))
        z = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log("p")).alias("l"), F.max(F.exp((F.col("a") - 1) * F.log("p"))).alias("m"))
        rows = {r["a"]: r for r in z.collect()}
        return [(math.log(rows[x]["z"]) - x * rows[x]["l"] / rows[x]["z"], rows[x]["m"] / rows[x]["z"] * budget / total) for x in map(float, points)]

    def bisect(meets) -> float:
        """The largest point up to which ``meets`` is true, from 0 on, where it is true first and false later."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            points = [lo + (hi - lo) * k / PARTS for k in range(PARTS + 1)]
            values = at(points)
            true = [x for x, v in zip(points, values, strict=True) if meets(v)]
            if not true or true[-1] >= hi:
                return hi if true else lo
            lo, hi = true[-1], points[points.index(true[-1]) + 1]
        return lo

    found = 1.0
    if entropy_share is not None:
        (most, _), (least, _) = at([0.0, 1.0])
        target = least + entropy_share * (most - least) - 1e-12
        found = bisect(lambda v: v[0] >= target)
    if max_repeats is not None:
        found = max(found, bisect(lambda v: v[1] > max_repeats))
    return found


#: Blocks, on average, of which one task finds the order; their number times this many blocks can be a source.
BUCKET_BLOCKS = 1_000


def _ranked(blocks: DataFrame) -> DataFrame:
    """``blocks(k, epoch, block, blocks, h, t)`` with ``rank``, the block's place among those of its source and pass by the hash ``h``, and ``upto``, the tokens up to it.

    Blocks fall into buckets by hash. Each bucket's count and tokens give what stands before the next, and only
    inside a bucket are blocks ordered, so no task orders a whole source.
    """
    rows = blocks.withColumn("bucket", F.floor(F.col("h") * F.ceil(F.col("blocks") / F.lit(BUCKET_BLOCKS))))
    unit = ["k", "epoch"]
    before = W.partitionBy(*unit).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = rows.groupBy(*unit, "bucket").agg(F.count("*").alias("n"), F.sum("t").alias("s"))
    buckets = buckets.select(*unit, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    inside = W.partitionBy(*unit, "bucket").orderBy("h", "block")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).withColumn("upto", F.sum("t").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return ranked.join(buckets, [*unit, "bucket"]).withColumns({"rank": F.col("rank") + F.col("n"), "upto": F.col("upto") + F.col("s")}).drop("n", "s", "bucket", "h")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", budget: float | None = None, entropy_share: float | None = 0.5, max_repeats: float | None = 4.0, seed: int = 7, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs``, as often as the mix takes them, with a struct ``mix``: ``source_weight``, ``n_tokens``,
    ``epoch`` (0 is the first pass over the source), ``block`` and ``position`` in [0, 1), by which the whole
    sample is to be ordered.

    A source's tokens (words) make its share; shares to the power of the exponent found by ``exponent``,
    normalised, are its weight, and weight times ``budget`` (all tokens, if not given) its token budget. Whole
    passes take all its documents. The rest is met by one more pass, up to the block in which the budget ends;
    there documents go in hash order while they fit, so a budget is never exceeded, and is missed by less than
    one document and its ties. In each pass a source's blocks have an order of their own, a permutation: of B
    blocks the one of rank r has the places from r / B to (r + 1) / B of the pass, and its documents stand there
    in hash order.

    Null sources are one source. Null and wordless texts hold no tokens; they go with their block, or, where a
    whole source has no token and so no weight, go from the mix with it. Repeated rows and equal ids share a
    place and go together. A column of ``docs`` named ``mix`` is replaced; other names do not clash. Blocks, and
    buckets of blocks, are all that is ordered under one key; a source with a third of all rows has as many as
    its size asks for. A text of any length counts whole. An empty table gives an empty one.
    """
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \x09-\x0D]+")), F.lit(0)).cast("bigint")
    place = _uniform(F.lit(seed), F.col(id))
    narrow = stored(docs.select(_key(F.col(source)).alias("k"), place.alias("u"), tokens.alias("t")), "mix-tokens")
    sources = stored(narrow.groupBy("k").agg(F.sum("t").alias("tokens")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    a = exponent(sources, budget, entropy_share, max_repeats)
    share = F.col("tokens") / F.lit(float(total or 1))
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.log(share))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = (
        sources.where("tokens > 0").withColumn("weight", power / F.lit(z)).withColumn("target", F.floor(F.col("weight") * F.lit(budget) + F.lit(1e-6)))
        .withColumn("passes", F.floor(F.col("target") / F.col("tokens")).cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block_words)))
    )
    plan = stored(plan, "mix-plan")

    block = F.least(F.floor(F.col("u") * F.col("blocks")), F.col("blocks") - 1)
    sizes = narrow.join(plan.select("k", "blocks"), "k").groupBy("k", block.alias("block")).agg(F.sum("t").alias("t"))
    each = sizes.join(plan.select("k", "passes", "blocks"), "k").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    ranked = stored(_ranked(each.withColumn("h", _uniform(F.lit(seed), F.col("k"), F.col("epoch"), F.col("block")))), "mix-ranks")
    ranks = ranked.groupBy("k", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "rank"))), lambda x: x["rank"]).alias("ranks"), F.max_by("t", "epoch").alias("t"), F.max_by("upto", "epoch").alias("upto"))
    run = ranks.join(plan.select("k", "passes", "rest", "tokens", "target", "weight"), "k")
    run = run.withColumn("left", F.col("rest") - (F.col("upto") - F.col("t"))).withColumn("more", F.when(F.col("left") >= F.col("t"), F.lit(2.0)).when(F.col("left") > 0, F.lit(None)).otherwise(F.lit(-1.0)))
    run = stored(run.select("k", "block", "ranks", "passes", "tokens", "target", "weight", "left", "more"), "mix-blocks")
    # ``more``: up to which place the block's documents go into the last pass; null where the budget ends inside.
    edge = narrow.join(plan.select("k", "blocks"), "k").withColumn("block", block).join(run.where("more is null").select("k", "block", "left"), ["k", "block"])
    fits = edge.withColumn("upto", F.sum("t").over(W.partitionBy("k", "block").orderBy("u"))).where("upto <= left").groupBy("k", "block").agg(F.max("u").alias("fits"))
    chosen = run.join(fits, ["k", "block"], "left").withColumn("more", F.coalesce("more", "fits", F.lit(-1.0))).join(plan.select("k", "blocks"), "k").select(*[F.col(c).alias(f"_mix_{c}") for c in ("k", "block", "blocks", "ranks", "passes", "tokens", "target", "weight", "more")])
    chosen = stored(chosen, "mix-chosen")
    counts = plan.select(F.col("k").alias("_mix_s"), F.col("blocks").alias("_mix_n"))
    rows = docs.drop("mix").withColumns({"_mix_key": _key(F.col(source)), "_mix_u": place, "_mix_t": tokens})
    rows = rows.join(counts, F.col("_mix_key") == F.col("_mix_s")).withColumn("_mix_b", F.least(F.floor(F.col("_mix_u") * F.col("_mix_n")), F.col("_mix_n") - 1))
    rows = rows.join(chosen, (F.col("_mix_key") == F.col("_mix_k")) & (F.col("_mix_b") == F.col("_mix_block")))
    copies = F.col("_mix_passes") + F.when(F.col("_mix_u") <= F.col("_mix_more"), F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("_mix_copies", copies).where("_mix_copies > 0").withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)))
    inside = F.col("_mix_u") * F.col("_mix_n") - F.col("_mix_block")
    along = (F.get("_mix_ranks", F.col("_mix_epoch")) + inside) / F.col("_mix_n")
    step = (F.col("_mix_epoch") + along) * F.col("_mix_tokens") / F.greatest("_mix_target", F.lit(1))
    value = F.struct(F.col("_mix_weight").alias("source_weight"), F.col("_mix_t").alias("n_tokens"), F.col("_mix_epoch").alias("epoch"), F.col("_mix_block").alias("block"), F.least(step, F.lit(1 - 1e-12)).alias("position"))
    return rows.select(*[c for c in docs.columns if c != "mix"], value.alias("mix"))
