"""URL filter by path templates: a tree per host, variable segments made wildcards, like branches merged, and
templates judged by smoothed labelled purity. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, rule: str) -> UrlRule:
        host, slash, path = rule.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeOptions:
    """``max_children``: from more distinct children on, a node's rarer ones are variable.
    ``min_share``: a child with this share of its node's urls stays literal all the same.
    ``z``: siblings whose block rates differ by less than so many standard errors are merged.
    ``prior``: labelled urls that the purity one level up counts for. ``purity``: from here on a template is rejected."""

    max_children: int = 8
    min_share: float = 0.1
    z: float = 1.64
    prior: float = 2.0
    purity: float = 0.7


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _ruled(rules: tuple[UrlRule, ...], host: Column, path: Column) -> Column:
    """Name and verdict of the longest rule that fits, as one CASE; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    """The path's segments, runs of digits as ``{n}`` and long hex as ``{x}``."""
    shaped = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}", "{x}"), r"\p{Nd}+", "{n}")
    return F.split(F.regexp_replace(shaped, "^/", ""), "/")


def _generalised(leaves: DataFrame, o: TreeOptions) -> DataFrame:
    """``leaves(host, segs, n, blocked, labelled)`` with ``tree``: each segment literal or ``*``, level by level below the ones already settled.

    Below a node with no more than ``max_children`` shapes nothing can become variable, so such shapes are done at once, however
    deep; there are as many rounds as levels at which more shapes than that share a node.
    """
    now, done, level = leaves.withColumn("tree", F.array().cast("array<string>")), None, 0
    while True:
        crowded = now.groupBy("host", "tree").agg(F.count("*").alias("shapes")).where(F.col("shapes") > o.max_children).select("host", "tree", F.lit(True).alias("crowded"))
        now = stored(now.join(crowded, ["host", "tree"], "left"), "url-trees")
        ended = F.col("crowded").isNull() | (F.size("segs") <= level)
        settled = now.where(ended).withColumn("tree", F.concat("tree", F.slice("segs", F.lit(level + 1), F.size("segs")))).drop("crowded")
        done = settled if done is None else done.unionByName(settled)
        live = now.where(~ended).drop("crowded")
        if live.isEmpty():
            return done
        seg = F.get("segs", F.lit(level))
        child = live.groupBy("host", "tree", seg.alias("seg")).agg(F.sum("n").alias("n"))
        node = child.groupBy("host", "tree").agg(F.sum("n").alias("all"), F.count("*").alias("children"))
        fixed = child.join(node, ["host", "tree"]).where((F.col("children") <= o.max_children) | (F.col("n") >= o.min_share * F.col("all"))).select("host", "tree", "seg", F.lit(True).alias("literal"))
        now = live.withColumn("seg", seg).join(fixed, ["host", "tree", "seg"], "left")
        now = stored(now.withColumn("tree", F.concat("tree", F.array(F.when(F.coalesce("literal", F.lit(False)), F.col("seg")).otherwise(F.lit("*"))))).drop("seg", "literal"), "url-trees")
        level += 1


def _runs(siblings: Column, o: TreeOptions) -> Column:
    """Runs of labelled ``siblings(rate, head, blocked, labelled)``, in order of their block rates: each joins the
    run before it unless the run's pooled rate is told apart from its own."""
    rate = lambda x: (x["blocked"] + 1) / (x["labelled"] + 2)
    var = lambda x: rate(x) * (1 - rate(x)) / (x["labelled"] + 2)
    start = F.expr("cast(array() as array<struct<blocked:bigint,labelled:bigint,heads:array<string>>>)")

    def add(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        same = F.coalesce(F.abs(rate(x) - rate(last)) <= o.z * F.sqrt(var(x) + var(last)), F.lit(False))
        own = F.struct(x["blocked"].alias("blocked"), x["labelled"].alias("labelled"), F.array(x["head"]).alias("heads"))
        grown = F.struct((last["blocked"] + x["blocked"]).alias("blocked"), (last["labelled"] + x["labelled"]).alias("labelled"), F.concat(last["heads"], F.array(x["head"])).alias("heads"))
        return F.when(same, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))).otherwise(F.concat(runs, F.array(own)))

    return F.aggregate(F.array_sort(siblings), start, add)


def _deepest_choice(rows: DataFrame, below: int | None) -> int | None:
    """The deepest level, above ``below``, at which templates that are the same before and after it differ; None if there is none."""
    spots = rows.select("host", "template").distinct().select("host", "template", F.posexplode("template").alias("level", "head"))
    if below is not None:
        spots = spots.where(F.col("level") < below)
    around = [F.xxhash64(F.slice("template", F.lit(1), F.col("level"))).alias("p"), F.xxhash64(F.slice("template", F.col("level") + 2, F.size("template"))).alias("q")]
    return spots.groupBy("host", "level", *around).agg(F.min("head").alias("lo"), F.max("head").alias("hi")).where("lo <> hi").agg(F.max("level")).first()[0]


def _merged(templates: DataFrame, o: TreeOptions) -> DataFrame:
    """``templates(host, tree, n, blocked, labelled)`` with ``template`` and ``rest``, what follows its first segment: siblings that have the same
    shape before and below their segment, and whose block rates are not told apart, share one template, named by all of them.

    Levels are merged from the deepest up, so branches whose insides have become alike can be merged in their turn. A branch without
    a label has the shape only to be known by. It joins its labelled siblings if these are alike; if they are told apart, or there are
    none, the branches without labels have one template of their own. A node has few children after wildcards were made, so its
    siblings are a short array.
    """
    rows, level = templates.withColumn("template", F.col("tree")), None
    while (level := _deepest_choice(rows, level)) is not None:
        key = {"prefix": F.slice("template", F.lit(1), F.lit(level)), "head": F.get("template", F.lit(level)), "suffix": F.slice("template", F.lit(level + 2), F.size("template"))}
        deep = rows.where(F.size("template") > level).withColumns(key)
        heads = deep.groupBy("host", "prefix", "suffix", "head").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
        labelled = F.when(F.col("labelled") > 0, F.struct(((F.col("blocked") + 1) / (F.col("labelled") + 2)).alias("rate"), "head", "blocked", "labelled"))
        nodes = heads.groupBy("host", "prefix", "suffix").agg(F.collect_list(labelled).alias("known"), F.collect_list(F.when(F.col("labelled") == 0, F.col("head"))).alias("open"))
        groups = F.transform(_runs(F.col("known"), o), lambda x: x["heads"])
        groups = F.when(F.size(groups) == 1, F.array(F.concat(F.get(groups, F.lit(0)), "open"))).when(F.size("open") > 0, F.concat(groups, F.array("open"))).otherwise(groups)
        named = nodes.select("host", "prefix", "suffix", F.explode(groups).alias("heads")).select("host", "prefix", "suffix", F.concat_ws("|", F.array_sort("heads")).alias("name"), F.explode("heads").alias("head"))
        changed = deep.join(named, ["host", "prefix", "suffix", "head"]).withColumn("template", F.concat("prefix", F.array("name"), "suffix")).select(rows.columns)
        rows = stored(changed.unionByName(rows.where(F.size("template") <= level)), "url-merging")
    return rows.withColumn("rest", F.slice("template", F.lit(2), F.size("template")))


def templates(urls: DataFrame, options: TreeOptions = TreeOptions()) -> DataFrame:
    """From ``urls(host, path, label)`` (label 1 for block, 0 for allow, null for none): one row per host and
    segment shape, with its ``template``, the template's ``n``, ``labelled``, ``blocked``, its smoothed
    ``purity`` and ``rejected``.

    Urls are first summed up by host and shape, so all that follows works on as many rows as there are shapes,
    and a host with a third of all urls has the few shapes that it has. A template's purity is smoothed by that
    of its node (all siblings of its shape), the node's by its host's, and that by the whole table's; the purity
    alone rejects, so labels reach urls that have none themselves. On a host without any label nothing is rejected.
    """
    o = options
    leaves = urls.groupBy("host", _segments(F.col("path")).alias("segs")).agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"), F.count("label").alias("labelled"))
    leaves = _generalised(stored(leaves, "url-shapes"), o)
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    merged = stored(_merged(leaves.groupBy("host", "tree").agg(*sums), o), "url-merged")
    whole = leaves.agg(F.sum("blocked"), F.sum("labelled")).first()
    above = F.lit(((whole[0] or 0) + 1) / ((whole[1] or 0) + 2))
    smoothed = lambda above: (F.sum("blocked") + o.prior * above) / (F.sum("labelled") + o.prior)
    hosts = merged.groupBy("host").agg(smoothed(above).alias("host_purity"), (F.sum("labelled") > 0).alias("judged"))
    nodes = merged.join(hosts, "host").groupBy("host", "rest").agg(smoothed(F.first("host_purity")).alias("node_purity"), F.first("judged").alias("judged"))
    judged = merged.join(nodes, ["host", "rest"]).groupBy("host", "template").agg(*sums, smoothed(F.first("node_purity")).alias("purity"), F.first("judged").alias("judged"))
    judged = judged.withColumn("rejected", F.col("judged") & (F.col("purity") >= o.purity))
    return leaves.select("host", "segs", "tree").join(merged.select("host", "tree", "template"), ["host", "tree"]).join(judged, ["host", "template"]).select("host", "segs", "template", "n", "labelled", "blocked", "purity", "rejected")


def judge(pages: DataFrame, rules: tuple[UrlRule, ...], url: str = "url", label: str | None = None, options: TreeOptions = TreeOptions()) -> DataFrame:
    """Every row of ``pages`` with a struct ``url_filter``: ``host``, ``path``, ``rule`` (the longest that fits,
    or null), ``template``, ``purity`` and ``verdict``: the rule's, else block for rejected templates, else allow.

    Labels are those of the column ``label`` (1 block, 0 allow, null none) if given, else the rules' verdicts.
    Null urls and urls without ``://`` have empty host and path
    and are judged like any other; repeated rows count each and are judged alike; a column named ``url_filter``
    is replaced, and no other name clashes; an empty table gives an empty one. A url of any length is judged whole.
    """
    rows = pages.drop("url_filter").withColumns({"_f_host": host_of(F.col(url)), "_f_path": path_of(F.col(url))})
    rows = rows.withColumn("_f_rule", _ruled(rules, F.col("_f_host"), F.col("_f_path")))
    own = F.col(label).cast("int") if label else F.when(F.col("_f_rule.verdict") == "block", 1).when(F.col("_f_rule.verdict") == "allow", 0)
    known = templates(rows.select(F.col("_f_host").alias("host"), F.col("_f_path").alias("path"), own.alias("label")), options)
    known = known.select(F.col("host").alias("_t_host"), F.col("segs").alias("_t_segs"), F.struct("template", "purity", "rejected").alias("_t"))
    rows = rows.withColumn("_f_segs", _segments(F.col("_f_path"))).join(known, (F.col("_f_host") == F.col("_t_host")) & (F.col("_f_segs") == F.col("_t_segs")), "left")
    verdict = F.coalesce("_f_rule.verdict", F.when(F.col("_t.rejected"), F.lit("block")), F.lit("allow"))
    value = F.struct(F.col("_f_host").alias("host"), F.col("_f_path").alias("path"), F.col("_f_rule.rule").alias("rule"), F.concat_ws("/", "_t.template").alias("template"), F.col("_t.purity").alias("purity"), verdict.alias("verdict"))
    return rows.select(*[c for c in pages.columns if c != "url_filter"], value.alias("url_filter"))
