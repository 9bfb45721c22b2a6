"""Line dedup by a segment-partition edit join, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import components, stored

#: Classes of lines by length: from so many characters on, lines within so many edits are the same; the shorter of two lines decides.
CLASSES = ((9, 1), (30, 2), (1_000, 4))
#: Up to so many ids of lines to be compared are sent to all tasks (16 MB); beyond, they are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: What is not counted at a line's ends.
BLANKS = " \t\r"
#: Words of 64 bits that say of which pairs of neighbouring characters a line has an odd number, to tell lines apart before they are compared; one more says it of characters.
PARITY_WORDS = 8


def _probes(edits: int) -> list[tuple[int, Column]]:
    """How much shorter the indexed line is, and the key, for each key of a line ``t`` of ``size`` characters: hashes of (length, segment number, substring) for every
    indexed length from its own down to ``edits`` less, at the starts that can still leave room for the other
    segments' edits.

    A line of length L is cut into edits + 1 segments, the last of which takes what does not divide; within
    ``edits`` edits at least one survives. The keys of length L at the segments' own places are the line's index;
    the rest only probe. ``t`` is in UTF-32, where a substring needs no walk through the characters before it.
    """
    parts, out = edits + 1, []
    for less in range(edits + 1):
        length, whole = f"(size - {less})", f"cast((size - {less}) div {parts} as int)"
        for i in range(1, parts + 1):
            width = whole if i < parts else f"({length} - {parts - 1} * {whole})"
            for move in _moves(i, less, edits):
                out.append((less, F.expr(f"xxhash64({i}, {length}, substring(t, 4 * ({i - 1} * {whole} + {move}) + 1, 4 * {width}))")))
    return out


def _moves(i: int, less: int, edits: int) -> range:
    """How far segment ``i`` of a line that is ``less`` characters shorter may have moved."""
    rest = edits + 1 - i
    return range(max(1 - i, less - rest), min(i - 1, less + rest) + 1)


def _own(edits: int) -> set[int]:
    """Which of ``_probes`` are the line's index."""
    places = [(less, move) for less in range(edits + 1) for i in range(1, edits + 2) for move in _moves(i, less, edits)]
    return {n for n, place in enumerate(places) if place == (0, 0)}


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(``doc``, ``line``, ``t``, ``size``, ``id``, ``check``) of each line that is not blank, without the blanks around it."""
    rows = docs.select(F.col(id).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "t"))
    padded = reduce(or_, [f(b) for b in BLANKS for f in (F.col("t").startswith, F.col("t").endswith)])  # to trim given characters walks through the whole line
    rows = rows.select("doc", "line", F.when(padded, F.trim(F.col("t"), F.lit(BLANKS))).otherwise(F.col("t")).alias("t"))
    rows = rows.withColumn("size", F.length("t")).where("size > 0")
    return rows.select("*", F.xxhash64("t").alias("id"), F.xxhash64(F.lit(1), "t").alias("check"))


def _parities(lines: DataFrame) -> DataFrame:
    """``lines(id, size, t)`` as (``id``, ``size``, ``parity``): a bit for each class by hash of the pairs of neighbouring characters, and of the characters, set if the line has an odd number of them.

    An edit takes away two pairs and adds two at most, so it turns four bits of pairs at most, and two of characters, wherever it is.
    """
    places = lines.select("id", "size", F.encode("t", "UTF-32").alias("t")).select("id", "size", "t", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    places = places.select("id", "size", F.expr("xxhash64(substring(t, 4 * i + 1, 8))").alias("g"), F.expr("xxhash64(substring(t, 4 * i + 1, 4))").alias("c"))  # see _probes
    bit = lambda h: f"shiftleft(1L, cast({h} & 63 as int))"
    words = [F.expr(f"bit_xor(if((shiftright(g, 6) & {PARITY_WORDS - 1}) = {w}, {bit('g')}, 0L))").alias(f"w{w}") for w in range(PARITY_WORDS)]
    return places.groupBy("id", "size").agg(*words, F.expr(f"bit_xor({bit('c')})").alias("one")).select("id", "size", F.struct(*[f"w{w}" for w in range(PARITY_WORDS)], "one").alias("parity"))


def _allowed(size: Column, classes: tuple[tuple[int, int], ...]) -> Column:
    """Within how many edits a line of ``size`` characters is the same as one that is no shorter."""
    out = F.lit(0)
    for least, edits in classes:
        out = F.when(size >= least, F.lit(edits)).otherwise(out)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, classes: tuple[tuple[int, int], ...]) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts are within the edits of the shorter one's class, by Spark's banded distance."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    size, near = F.least(F.length("ta"), F.length("tb")), F.lit(False)
    for least, edits in classes:
        near = F.when(size >= least, F.levenshtein("ta", "tb", edits) >= 0).otherwise(near)
    return both.where(near).select("a", "b")


def _entries(lines: DataFrame, classes: tuple[tuple[int, int], ...]) -> DataFrame:
    """(``key``, ``probe``, ``id``) of the distinct lines, class by class.

    The class of the shorter line says how it is cut, so a line just above a class's lengths also probes that class.
    A key holds the length of the lines in its index, which probes exceed by no more than the edits: lines that meet
    one of an index are near in length. Each key is a column until equal lines are one, for arrays would be sorted there.
    """
    out = None
    for n, (least, edits) in enumerate(classes):
        end = classes[n + 1][0] if n + 1 < len(classes) else None
        below = lambda size: F.lit(True) if end is None else size < end  # noqa: B023, E731
        probes, own = _probes(edits), _own(edits)
        keys = [key for _, key in sorted((k not in own, k) for k in range(len(probes)))]  # those of the index first
        names = [f"k{k}" for k in keys]
        some = lines.where((F.col("size") >= least) & below(F.col("size") - edits)).withColumn("t", F.encode("t", "UTF-32"))
        some = some.select("id", *[F.when((F.col("size") - probes[k][0] >= least) & below(F.col("size") - probes[k][0]), probes[k][1]).alias(f"k{k}") for k in keys])
        some = some.groupBy("id").agg(*[F.max(name).alias(name) for name in names])  # equal lines have equal keys
        some = some.select("id", F.posexplode(F.array(*names)).alias("n", "key")).where("key is not null")
        some = some.select("key", (F.col("n") > edits).alias("probe"), "id")
        out = some if out is None else out.unionByName(some)
    return out


def edit_links(lines: DataFrame, classes: tuple[tuple[int, int], ...] = CLASSES) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``lines(id, t, size)`` within their class's edits of each other.

    In each key all lines are first compared with the one of least id that has the key in its index, so a key
    shared by very many lines costs as many comparisons as it has lines. Keys whose lines are not in one component
    after that are compared in full across components, so no link between different texts is lost.
    """
    order = W.partitionBy("key").orderBy("probe", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.first(F.struct("probe", "id")).over(order)
    starred = _entries(lines, classes).withColumn("first", first).where("id <> first.id and not first.probe").select("key", "probe", "id", F.col("first.id").alias("head"))
    starred = stored(starred, "line-keys")
    pairs = stored(starred.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct(), "line-pairs")
    wanted = stored(starred.select("id").union(starred.select("head")).distinct(), "line-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = lines.select("id", "t").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("t").alias("t"))
    texts = stored(texts.select("id", F.length("t").alias("size"), "t"), "line-texts")
    links = stored(_verified(pairs, texts, classes), "line-links")
    roots = components(links)
    # What is left: keys that still hold more than one component; in them all that has the key in its index meets all that probes it.
    members = starred.select("key", "probe", "id").union(starred.select("key", F.lit(False), "head")).distinct()
    members = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("key")
    rest = stored(members.join(mixed, "key", "left_semi"), "line-rest")
    parities = stored(_parities(texts.join(rest.select("id").distinct(), "id", "left_semi")), "line-parities")
    rest = rest.join(parities, "id")
    index = rest.where("not probe").select("key", F.col("id").alias("a"), F.col("size").alias("sa"), F.col("root").alias("ra"), F.col("parity").alias("pa"))
    probe = rest.select("key", F.col("id").alias("b"), F.col("size").alias("sb"), F.col("root").alias("rb"), F.col("parity").alias("pb"))
    turned = lambda w: F.bit_count(F.col(f"pa.{w}").bitwiseXOR(F.col(f"pb.{w}")))
    edits = _allowed(F.least("sa", "sb"), classes)
    near = (turned("one") <= 2 * edits) & (sum((turned(f"w{w}") for w in range(PARITY_WORDS)), F.lit(0)) <= 4 * edits)
    across = index.join(probe, "key").where((F.col("ra") != F.col("rb")) & near)
    more = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return links.unionByName(_verified(more, texts, classes))


def duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", classes: tuple[tuple[int, int], ...] = CLASSES) -> DataFrame:
    """(``doc``, ``removed``): of each document that loses lines, their numbers from 0.

    Lines are compared without the blanks around them. Equal lines of any length, and lines within as many edits of
    each other as ``classes`` (least characters, edits) allow for the shorter one, make classes (components of the
    links); the first occurrence by document id and line number stays, every later one is removed. Blank lines stay.
    Rows that share an id are one document; a null id comes first. Null and empty texts lose nothing.
    """
    classes = tuple(sorted(classes))
    if any(least < (edits + 1) ** 2 for least, edits in classes):
        raise ValueError("lines must be longer than their segments can move")
    lines = _lines(docs, id, text)
    distinct = lines.groupBy("id", "check").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    distinct = stored(distinct, "lines")
    roots = components(edit_links(lines, classes))
    # Of every class: the first occurrence. Only lines that occur again, or are linked, can lose anything.
    classed = distinct.join(roots, "id", "left").where("n > 1 or root is not null").withColumn("linked", F.col("root").isNotNull())
    classed = classed.withColumn("class", F.when(F.col("linked"), F.struct("root", F.lit(0).cast("bigint").alias("c"))).otherwise(F.struct(F.col("id").alias("root"), F.col("check").alias("c"))))
    firsts = classed.groupBy("class", "linked").agg(F.min("first").alias("keep"))
    ruled = stored(classed.join(firsts, ["class", "linked"]).select("id", "check", "keep"), "line-rules")
    gone = lines.select("doc", "line", "id", "check").join(ruled, ["id", "check"]).where(~F.struct("doc", "line").eqNullSafe(F.col("keep")))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", classes: tuple[tuple[int, int], ...] = CLASSES) -> DataFrame:
    """Every row of ``docs`` with its text less the lines that ``duplicates`` removes, and a struct ``lines``: ``n_lines``, ``n_removed``, ``removed``.

    Other columns stay, whatever their names, but for one named ``lines``, which is replaced. An empty table gives an empty one.
    """
    gone = duplicates(docs, id, text, classes).select(F.col("doc").alias("_line_doc"), F.col("removed").alias("_line_gone"))
    counted = docs.drop("lines").withColumn("_line_n", F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)))  # before the join, so that who wants no text shuffles none
    rows = counted.join(gone, F.col(id).eqNullSafe(F.col("_line_doc")), "left")
    removed = F.coalesce("_line_gone", F.array().cast("array<int>"))
    parts = F.split(F.col(text), "\n")
    kept = F.when(F.size(removed) == 0, F.col(text)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(removed, i)), "\n"))
    value = F.struct(F.col("_line_n").alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"))
    return rows.select(*[kept.alias(c) if c == text else F.col(c) for c in docs.columns if c != "lines"], value.alias("lines"))
