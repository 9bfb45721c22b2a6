"""Counts, distributions, votes, adherence, recall and training weights, each as a DataFrame of few rows or a column on many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.checkpoints import stored


def distribution(rows: DataFrame, column: str, blank: str = "(none)") -> DataFrame:
    """(``value``, ``n``), most frequent first and then by name; null and blank values are the named bucket, so the counts add up to the rows."""
    value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(blank))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def facets(rows: DataFrame, columns: list[str], blank: str = "(none)") -> DataFrame:
    """(``facet``, ``value``, ``n``) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(blank)).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def top_and_other(rows: DataFrame, column: str, k: int = 10, other: str = "other") -> DataFrame:
    """The ``k`` most frequent values, and one row for the rest if there is any."""
    ranked = distribution(rows, column).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "value")))
    return ranked.groupBy(F.when(F.col("r") <= k, F.col("value")).otherwise(F.lit(other)).alias("value")).agg(F.sum("n").alias("n"))


def year_stats(rows: DataFrame, year: Column) -> DataFrame:
    """One row: least and greatest known year, how many are known, and how many are not."""
    known = F.when(year.between(1990, 2100), year)
    return rows.agg(F.min(known).alias("first_year"), F.max(known).alias("last_year"), F.count(known).alias("known"), F.count_if(known.isNull()).alias("unknown"))


def with_total(rows: DataFrame, key: str, *sums: Column, total: str = "ALL") -> DataFrame:
    """A row per key and one for all."""
    out = rows.groupBy(F.coalesce(F.col(key), F.lit("(none)")).alias("_k")).agg(*sums)
    names = [c for c in out.columns if c != "_k"]
    return out.rollup("_k").agg(*[F.sum(n).alias(n) for n in names]).select(F.coalesce("_k", F.lit(total)).alias(key), *names)


def distinct_values(rows: DataFrame, *columns: str) -> DataFrame:
    """How many values each column has, null counted as one."""
    return rows.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}") for c in columns])


def drop_accounting(gated: DataFrame, source: str, reason: str = "drop_reason") -> DataFrame:
    """(source, reason, ``n``); kept rows have the reason ``kept``. The counts of a source add up to what came in."""
    return gated.groupBy(source, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def duplicate_rate(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the share of rows whose values occur more than once."""
    groups = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicated")).withColumn("rate", F.round(F.col("n_duplicated") / F.col("n_rows"), 6))


def majority_vote(votes: DataFrame, id: str, label: str, confidence: str) -> DataFrame:
    """Per id: the most frequent label (the least on a tie), mean confidence to 3 places, number of passes, and whether all agree."""
    return votes.groupBy(id).agg(F.mode(label, True).alias("label"), F.round(F.avg(confidence), 3).alias("confidence"), F.count("*").alias("passes"), (F.countDistinct(label) == 1).alias("agree"))


def two_model_vote(a: DataFrame, b: DataFrame, id: str, positive: str = "positive") -> DataFrame:
    """Of two legs with a boolean ``positive``: ``aligned`` if both, ``partial`` if one, ``unaligned`` if none; null where a leg is missing."""
    both = a.select(id, F.col(positive).cast("int").alias("a")).join(b.select(id, F.col(positive).cast("int").alias("b")), id, "full")
    label = F.when(F.col("a") + F.col("b") == 2, "aligned").when(F.col("a") + F.col("b") == 1, "partial").when(F.col("a") + F.col("b") == 0, "unaligned")
    return both.select(id, label.alias("label"), (F.col("a") != F.col("b")).alias("disagree"))


def rule_adherence(rows: DataFrame, rules: dict[str, tuple[Column, Column]], example: Column) -> DataFrame:
    """Per rule, given as (applies, follows): ``applicable``, ``followed``, ``rate``, the least example that follows, and a verdict by .7 and .5."""
    flags = F.array(*[F.struct(F.lit(n).alias("rule"), a.alias("applies"), (a & f).alias("follows"), example.alias("example")) for n, (a, f) in rules.items()])
    long = rows.select(F.explode(flags).alias("r")).select("r.*").where("applies")
    out = long.groupBy("rule").agg(F.count("*").alias("applicable"), F.count_if("follows").alias("followed"), F.min(F.when(F.col("follows"), F.col("example"))).alias("example"))
    rate = F.round(F.col("followed") / F.col("applicable"), 6)
    return out.withColumn("rate", rate).withColumn("verdict", F.when(rate >= 0.7, "strong").when(rate >= 0.5, "mixed").otherwise("weak"))


def planted_recall(drafts: DataFrame, id: str, by: list[str]) -> DataFrame:
    """Per class of planted errors: pairs that can be tested, those in which the aimed check ``failed``, and the share.

    ``drafts`` has a faithful draft (``base``) and a spoilt one of each pair. A pair whose base already fails proves nothing and
    is left out; a class that is never found is in the result with 0.
    """
    pairs = drafts.groupBy(id, *by).agg(F.max(F.when(F.col("base"), F.col("failed"))).alias("base_failed"), F.max(F.when(~F.col("base"), F.col("failed"))).alias("found"))
    rows = pairs.where("not base_failed and found is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("found").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n"), 6))


def threshold_sweep(scored: DataFrame, score: str, truth: str, thresholds: list[float], most_false: float = 0.1) -> DataFrame:
    """Per threshold: recall and false positive rate of ``score < threshold``, and whether it is the best recall with a rate of at most ``most_false``."""
    points = scored.select(score, truth, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")).withColumn("hit", F.col(score) < F.col("threshold"))
    rates = points.groupBy("threshold").agg(F.round(F.avg(F.when(F.col(truth), F.col("hit").cast("int"))), 6).alias("recall"), F.round(F.avg(F.when(~F.col(truth), F.col("hit").cast("int"))), 6).alias("false_rate"))
    best = F.max_by("threshold", F.when(F.col("false_rate") <= most_false, F.struct("recall", -F.col("threshold")))).over(W.partitionBy(F.lit(1)))
    return rates.withColumn("best", F.coalesce(F.col("threshold") == best, F.lit(False)))


def accuracy(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    return rows.where(F.col(truth).isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(F.col(predicted).eqNullSafe(F.col(truth)).cast("int")), 6).alias("accuracy"))


def group_composition(members: DataFrame, group: str, kind: str) -> DataFrame:
    """How many groups have which sorted set of kinds."""
    sets = members.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("kinds"), F.count("*").alias("size"))
    return sets.groupBy("kinds").agg(F.count("*").alias("n_groups"), F.sum("size").alias("n_rows"))


def sha_duplicates(files: DataFrame, sha: str, member: str) -> DataFrame:
    """Hashes that occur more than once, with their members in order."""
    return files.where(F.col(sha).isNotNull()).groupBy(sha).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members")).where("n > 1")


def mix_weights(rows: DataFrame, tier: str, organisation: str, tokens: str, shares: dict[str, float], cap: float = 0.45, rounds: int = 12) -> DataFrame:
    """``rows`` with ``weight``: each tier's tokens make up its share, no organisation more than ``cap`` of a tier, mean 1 over all, to 6 places.

    The cap is met by a few rounds on the table of tiers and organisations: what is above it is set to it, and
    the rest scaled to what remains, until nothing is above. Where fewer organisations than 1 / ``cap`` make a
    cap impossible, they share alike.
    """
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, float(v))]), F.col(tier))
    by = W.partitionBy(tier)
    parts = rows.where(share.isNotNull()).groupBy(tier, organisation).agg(F.sum(tokens).alias("t"), F.count("*").alias("c"))
    parts = parts.withColumn("raw", F.col("t") / F.sum("t").over(by)).withColumn("most", F.greatest(F.lit(cap), 1 / F.count("*").over(by))).withColumn("part", F.col("raw")).withColumn("fixed", F.lit(False))
    for _ in range(rounds):
        parts = parts.withColumn("fixed", F.col("fixed") | (F.col("part") > F.col("most") + 1e-12))
        left = 1 - F.sum(F.when(F.col("fixed"), F.col("most")).otherwise(0.0)).over(by)
        loose = F.sum(F.when(F.col("fixed"), 0.0).otherwise(F.col("raw"))).over(by)
        parts = parts.withColumn("part", F.when(F.col("fixed"), F.col("most")).otherwise(F.when(loose > 0, F.col("raw") / loose * left).otherwise(0.0)))
    parts = parts.withColumn("w", F.when(F.col("t") > 0, F.col("part") * share / F.col("t")).otherwise(0.0))
    mean = F.sum(F.col("w") * F.col("c")).over(W.partitionBy(F.lit(1))) / F.sum("c").over(W.partitionBy(F.lit(1)))
    weights = parts.select(F.col(tier).alias("_tier"), F.col(organisation).alias("_org"), F.round(F.col("w") / mean, 6).alias("weight"))
    return rows.join(weights, (F.col(tier) == F.col("_tier")) & F.col(organisation).eqNullSafe(F.col("_org"))).drop("_tier", "_org")


def running_total(rows: DataFrame, order: list[str], cost: str, name: str = "spent", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``cost`` over all rows up to and with this one in ``order``; null costs count as 0.

    A prefix sum in three steps, none of which sees all rows: rows are dealt out by ranges of ``order`` and written; each range
    is summed; each gets the sum of those before it as an offset, and a window runs within the range only. Ranges are cut
    by the whole order, so let it end with a key: a value that a third of all rows share is then cut too. Equal rows of
    the order are summed one after the other, which first is not said.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.coalesce(F.col(cost), F.lit(0))
    dealt = stored(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))  # a row for each range
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return dealt.withColumn(name, within).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def within_budget(rows: DataFrame, order: list[str], cost: str, cap: float, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``spent``, the running cost in order, and ``paid``: whether it is still within ``cap``; over all rows, or for each ``by``."""
    if by is None:
        out = running_total(rows, order, cost)
    else:
        out = rows.withColumn("spent", F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.withColumn("paid", F.col("spent") <= cap)


def seeded(key: str, seed: int) -> Column:
    """A number for order, of seed and key only."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def sample_by_class(rows: DataFrame, kind: str, key: str, each: int, seed: int) -> DataFrame:
    """At most ``each`` rows of each class, first by a hash of seed and key: the same in every run, however the rows are partitioned.

    Each task keeps its own best ``each`` of a class before anything is shuffled (up to 1000 of them, see
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so a class that most rows have is no hot group. Null is a class.
    """
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(kind).orderBy(seeded(key, seed), key))).where(F.col("_r") <= each).drop("_r")


def made_negatives(positives: DataFrame, pool: DataFrame, group: str, key: str, source: str, draft: str, seed: int) -> DataFrame:
    """``positives`` with the source of another pair of their group in place of their own: pairs that are known to be wrong.

    The other is the first of the group by a hash of seed and key whose source differs; of each group two candidates are kept by
    aggregation, so groups are never gathered. A pair whose group has no other source gives none. ``key`` ends with ``-NEG``.
    """
    order = F.struct(seeded(key, seed).alias("h"), F.col(key).alias("k"), F.col(source).alias("s"))
    own = pool.where(F.col(source).isNotNull())
    first = own.groupBy(F.col(group).alias("_g")).agg(F.min(order).alias("_a"))
    second = own.join(first, F.col(group).eqNullSafe(F.col("_g"))).where(F.col(source) != F.col("_a.s")).groupBy("_g").agg(F.min(order).alias("_b"))
    both = first.join(second.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    out = positives.join(both, F.col(group).eqNullSafe(F.col("_g")))
    wrong = F.when(F.col("_a.s").eqNullSafe(F.col(source)), F.col("_b.s")).otherwise(F.col("_a.s"))
    return out.withColumns({source: wrong, key: F.concat(F.col(key).cast("string"), F.lit("-NEG"))}).select(*positives.columns)


def hash_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, first by a hash of seed and key: the same in every run, however the rows are partitioned."""
    return rows.orderBy(seeded(key, seed), key).limit(most)
