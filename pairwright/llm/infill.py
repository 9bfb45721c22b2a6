"""Fill-in-the-middle: documents cut between two units and put together again around sentinels, with cuts found relationally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import let
from .store import stored

#: The sentinels before the three parts, and what a unit of a text is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Units in a block. Blocks are summed first, and only the blocks in which a cut falls are taken apart.
BLOCK = 64
_BLOCKS = rf"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}+"


def n_units(text: Column) -> Column:
    """How many units ``text`` has: its code points, a run of letters counting as one."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("bigint")


def hashes(id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: groups of eight digits of the SHA-256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _requests(text: Column, id: Column, seed: int, plain_percent: int, spm_percent: int) -> dict[str, Column]:
    """What a document asks for by its id and text: its form, and after how many units its prefix and its middle end."""
    h1, h2, h3, h4 = hashes(id, seed)
    n = n_units(text)
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= 100 - plain_percent)
    return {
        "form": F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"),
        "n": n,
        "first": F.least(h1 % (n + 1), h2 % (n + 1)),
        "second": F.greatest(h1 % (n + 1), h2 % (n + 1)),
    }


def offsets(docs: DataFrame) -> DataFrame:
    """(``k1``, ``k2``, ``n``, ``first_at``, ``second_at``): at which code points the cuts of ``docs(k1, k2, text, n, first, second)`` fall.

    A text's units are matched in blocks of ``BLOCK``. What leaves the text is the length of each block and, for each of its
    two cut requests, the lengths of the units up to the cut in the block that holds it; equal documents become one there.
    From then on units are rows: blocks come out by ``posexplode`` and a window sums their lengths, so each knows where it
    starts; requests are joined with their block; their units come out by ``posexplode`` and a window sums them too; the row
    with the asked ordinal has the place, and one aggregation gives each document its two. All of it is partitioned by document.
    """
    held = lambda cut: F.floor((F.col(cut) - 1) / BLOCK).cast("int")  # noqa: E731  -1 where the cut is at the start
    ordinal = lambda cut: ((F.col(cut) - 1) % BLOCK).cast("int")

    def request(cut: str, matches: Column) -> Column:
        units = F.regexp_extract_all(F.get(matches, held(cut)), F.lit(UNIT), F.lit(0))
        return F.struct(F.lit(cut).alias("cut"), held(cut).alias("held"), ordinal(cut).alias("ordinal"), F.transform(F.slice(units, F.lit(1), ordinal(cut) + 1), F.length).alias("units"))

    found = let(F.regexp_extract_all("text", F.lit(_BLOCKS), F.lit(0)), lambda m: F.struct(F.transform(m, F.length).alias("blocks"), F.array(request("first", m), request("second", m)).alias("requests")))
    asked = stored(docs.select("k1", "k2", F.struct("n", found.alias("found")).alias("x")).groupBy("k1", "k2").agg(F.first("x").alias("x")), "cuts").repartition("k1", "k2")
    before = W.partitionBy("k1", "k2").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = asked.select("k1", "k2", F.posexplode("x.found.blocks").alias("block", "chars")).select("k1", "k2", "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"))
    requests = asked.select("k1", "k2", F.explode("x.found.requests").alias("r")).select("k1", "k2", "r.*")
    its_block = (F.col("held") >= F.col("block")) & (F.col("held") <= F.col("block"))  # not a key of the join, which is by document
    units = requests.join(blocks, ["k1", "k2"]).where(its_block).select("k1", "k2", "cut", "start", "ordinal", F.posexplode("units").alias("unit", "chars"))
    until = W.partitionBy("k1", "k2", "cut").orderBy("unit").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = units.withColumn("at", F.col("start") + F.sum("chars").over(until)).where("unit = ordinal")
    places = hits.groupBy("k1", "k2").agg(*[F.max(F.when(F.col("cut") == c, F.col("at"))).alias(f"{c}_at") for c in ("first", "second")])
    return asked.select("k1", "k2", "x.n").join(places, ["k1", "k2"], "left").fillna(0, ["first_at", "second_at"])


def infill(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Every row of ``docs`` with a struct ``fim``: ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The cuts are those of ``offsets``; a document's numbers come from ``seed`` and its id only, so a run gives what
    any other gives. Of the forms, ``plain`` leaves the text as it is (its parts are null), ``psm`` puts the
    middle last, and ``spm`` also the suffix first. Null texts count as empty; empty texts and texts that hold a
    sentinel are plain. Null ids count as one empty id. Rows with equal ids have the same numbers, and equal rows
    the same result. Columns of ``docs`` stay whatever their names, but one named ``fim`` is replaced; an empty table
    gives an empty one. Texts are shuffled once, to meet their cuts; a text has to fit in a task.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    ask = _requests(whole, F.col(id), seed, plain_percent, spm_percent)
    key = [F.xxhash64(id).alias("k1"), F.xxhash64(whole, F.lit(0)).alias("k2")]
    wanted = docs.select(*key, whole.alias("text"), *[v.alias(k) for k, v in ask.items()]).where("form <> 'plain'").drop("form")
    rows = docs.select(F.struct("*").alias("row"), *key)  # the text once
    joined = rows.join(offsets(wanted), ["k1", "k2"], "left").withColumn("form", _requests(F.coalesce(F.col("row").getField(text), F.lit("")), F.col("row").getField(id), seed, plain_percent, spm_percent)["form"])
    x, a, b = F.coalesce(F.col("row").getField(text), F.lit("")), F.col("first_at").cast("int"), F.col("second_at").cast("int")
    prefix, middle, suffix = F.substring(x, F.lit(1), a), F.substring(x, a + 1, b - a), F.substring(x, b + 1, F.length(x))
    plain = F.col("form") == "plain"
    output = (
        F.when(plain, x)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    part = lambda v: F.when(~plain, v.cast("bigint"))
    fim = F.struct(F.coalesce("n", n_units(x)).alias("n"), "form", part(a).alias("prefix_chars"), part(b - a).alias("middle_chars"), output.alias("output"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "fim"], fim.alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that was cut holds no sentinel, and none can arise at a seam, so the three found are those put in."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    p = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(p(1), p(3), p(2))).otherwise(F.concat(p(2), p(3), p(1)))
