import re

import pytest
from pairwright.llm import urltree
from pairwright.llm.queries import URL_RULES
from pyspark.sql import functions as F


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id bigint, url string")

    return make


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x=/de/", "http://example.org/en/2", "http://notexample.org/es/1", "http://x.com/de/5#f", "http://x.com/fr", "http://x.com/fr/", "http://x.com?y=/de/",
    "http://x.net/de/9", "ftp://É.ORG/q", "http://org/", "http://com/de/", "a://b://c.com/de/1", "http://x.com/de/" + "y/" * 500,
]


def test_rules_and_parts(pages):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(4, URLS[4])]
    out = urltree.judge(pages(rows).withColumns({"url_filter": F.lit("clash"), "host": F.lit("clash")}), URL_RULES)
    assert out.count() == len(rows)
    for r in out.collect():
        f, (host, path) = r["url_filter"], parts(r["url"])
        assert (f["host"], f["path"]) == (host, path), r["url"]
        want = rule(host, path)
        assert f["rule"] == (want.name if want else None)
        assert f["verdict"] == (want.verdict if want else "allow")


def test_templates_are_rejected_by_purity(pages):
    rows = [(k, f"http://spam.net/offer/{k}/buy") for k in range(40)] + [(100 + k, f"http://spam.net/news/{k}") for k in range(40)]
    rows += [(200 + k, f"http://big.net/{w}/{k}") for k, w in enumerate("abcdefghijklmnopqrstuvwxyz")]
    table = pages(rows).withColumn("bad", F.when((F.col("page_id") < 20), 1).when(F.col("page_id").between(100, 120), 0))
    got = {r["page_id"]: r["url_filter"] for r in urltree.judge(table, (), label="bad").collect()}
    assert all(got[k]["verdict"] == "block" for k in range(40)) and all(got[k]["verdict"] == "allow" for k in range(100, 140))
    assert {got[200 + k]["template"] for k in range(26)} == {"*/{n}"}
    assert got[0]["template"] == "offer/{n}/buy"


def test_like_branches_are_merged(spark):
    rows = [("h", f"/{w}/{k}", label) for w, label in (("a", 1), ("b", 1), ("c", 0)) for k in range(30)]
    out = urltree.templates(spark.createDataFrame(rows, "host string, path string, label int"))
    got = {tuple(r["segs"]): (r["template"][0], r["rejected"]) for r in out.collect()}
    assert got[("a", "{n}")] == got[("b", "{n}")] == ("a|b", True) and got[("c", "{n}")] == ("c", False)


def plain_tree(urls, o):
    """The tree in dictionaries: ``urls`` of (host, path, label); gives template, purity and verdict by (host, segments)."""
    leaves = {}
    for host, path, label in urls:
        p = re.sub(r"\d+", "{n}", re.sub(r"[0-9a-fA-F]{16,}", "{x}", path)).removeprefix("/").split("/")
        segs = tuple(p)
        n, blocked, labelled = leaves.get((host, segs), (0, 0, 0))
        leaves[host, segs] = (n + 1, blocked + (label or 0), labelled + (label is not None))
    tree = {k: () for k in leaves}
    deepest = max(len(k[1]) for k in leaves)
    for level in range(deepest):
        nodes = {}
        for (host, segs), v in leaves.items():
            if len(segs) > level:
                child = nodes.setdefault((host, tree[host, segs]), {})
                child[segs[level]] = child.get(segs[level], 0) + v[0]
        for k in leaves:
            if len(k[1]) > level:
                child = nodes[k[0], tree[k]]
                literal = len(child) <= o.max_children or child[k[1][level]] >= o.min_share * sum(child.values())
                tree[k] = (*tree[k], k[1][level] if literal else "*")
    sums = {}
    for k, v in leaves.items():
        have = sums.get((k[0], tree[k]), (0, 0))
        sums[k[0], tree[k]] = (have[0] + v[1], have[1] + v[2])
    rate = lambda b, n: (b + 1) / (n + 2)
    var = lambda b, n: rate(b, n) * (1 - rate(b, n)) / (n + 2)
    template = {k: k[1] for k in sums}
    for level in reversed(range(deepest)):
        cut = lambda k: (k[0], template[k][:level], template[k][level + 1 :])  # noqa: B023, E731
        for node in {cut(k) for k in sums if len(template[k]) > level}:
            mine = {}
            for k in sums:
                if len(template[k]) > level and cut(k) == node:
                    mine.setdefault(template[k][level], []).append(k)
            have = {head: (sum(sums[k][0] for k in ks), sum(sums[k][1] for k in ks)) for head, ks in mine.items()}
            groups = []
            for head in sorted((h for h in mine if have[h][1]), key=lambda h: (rate(*have[h]), h)):
                b, n = have[head]
                if groups and abs(rate(b, n) - rate(*groups[-1][0])) <= o.z * (var(b, n) + var(*groups[-1][0])) ** 0.5:
                    groups[-1] = ((groups[-1][0][0] + b, groups[-1][0][1] + n), [*groups[-1][1], head])
                else:
                    groups.append(((b, n), [head]))
            free = [h for h in mine if not have[h][1]]
            if len(groups) == 1:
                groups[0][1].extend(free)
            elif free:
                groups.append(((0, 0), free))
            renamed = {k: (*node[1], "|".join(sorted(heads)), *node[2]) for _, heads in groups for h in heads for k in mine[h]}
            template |= renamed
    total = lambda keys: (sum(sums[k][0] for k in keys), sum(sums[k][1] for k in keys))
    smooth = lambda keys, above: (total(keys)[0] + o.prior * above) / (total(keys)[1] + o.prior)
    out = {}
    for k in leaves:
        host, t = k[0], tree[k]
        p = rate(*total(sums))
        for keys in ([x for x in sums if x[0] == host], [x for x in sums if x[0] == host and template[x][1:] == template[host, t][1:]], [x for x in sums if x[0] == host and template[x] == template[host, t]]):
            p = smooth(keys, p)
        out[k] = (template[host, t], round(p, 9), p >= o.purity and total([x for x in sums if x[0] == host])[1] > 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_tree(spark, seed):
    rng = __import__("random").Random(seed)
    o = urltree.TreeOptions(max_children=3, min_share=0.15)
    urls = []
    for _ in range(700):
        host, a = rng.choice(["a.net", "b.net", "c.com"]), rng.choice("pqrstuvw"[: rng.choice([2, 8])])
        path = "/" + "/".join([a, *(rng.choice(["x", "y", str(rng.randint(1, 99)), "k" + rng.choice("abcdefgh")]) for _ in range(rng.randint(0, 4)))])
        urls.append((host, path, rng.choice([None, None, int(a in "pq" or rng.random() < 0.1)]) if host != "c.com" else None))
    out = urltree.templates(spark.createDataFrame(urls, "host string, path string, label int"), o)
    got = {(r["host"], tuple(r["segs"])): (tuple(r["template"]), round(r["purity"], 9), r["rejected"]) for r in out.collect()}
    want = plain_tree(urls, o)
    assert got == want and {r for _, _, r in want.values()} == {True, False}


def test_purity_reaches_branches_without_a_label(pages):
    rows = [(k, f"http://x.com/de/{k}") for k in range(20)] + [(100 + k, f"http://x.com/en/{k}") for k in range(20)]
    rows += [(200 + k, f"http://y.com/{w}/{k}") for k, w in enumerate(["de", "fr"] * 10)] + [(300, "http://y.com/en/1"), (400, "http://z.net/en/1"), (401, "http://z.net/" + "q" * 1_000_001)]
    got = {r["page_id"]: r["url_filter"] for r in urltree.judge(pages(rows), URL_RULES).collect()}
    assert {got[k]["rule"] for k in range(100, 120)} == {None} and {got[k]["verdict"] for k in range(100, 120)} == {"block"}
    assert got[300]["verdict"] == got[400]["verdict"] == got[401]["verdict"] == "allow"
    assert got[100]["template"] == "de|en/{n}" and got[300]["template"] == "en/{n}"


def test_branches_merge_on_every_level(spark):
    rows = [("h", f"/s/{a}/{b}/{k}", label) for a, b, label in (("p", "u", 1), ("p", "v", 1), ("q", "u", 1), ("q", "v", 1), ("r", "u", 0)) for k in range(30)]
    rows += [("g", "/deep" * 40 + f"/{w}/{k}", int(w == "x")) for w in "xyz" for k in range(20)]
    out = urltree.templates(spark.createDataFrame(rows, "host string, path string, label int"))
    got = {(r["host"], tuple(r["segs"])): ("/".join(r["template"]), r["rejected"]) for r in out.collect()}
    assert got[("h", ("s", "p", "u", "{n}"))] == got[("h", ("s", "q", "v", "{n}"))] == ("s/p|q/u|v/{n}", True)
    assert got[("h", ("s", "r", "u", "{n}"))] == ("s/r/u/{n}", False)
    assert got[("g", (*["deep"] * 40, "y", "{n}"))] == ("deep/" * 40 + "y|z/{n}", False) and got[("g", (*["deep"] * 40, "x", "{n}"))][1]


def test_equal_rates_and_repeated_urls(pages):
    rows = [(k, f"http://t.com/{w}/{k}") for w in "ab" for k in range(10)] * 2
    out = urltree.judge(pages(rows).withColumn("bad", F.col("page_id").cast("int") % 2), (), label="bad")
    assert {r["url_filter"]["template"] for r in out.collect()} == {"a|b/{n}"} and out.count() == len(rows)


def test_empty(pages):
    assert urltree.judge(pages([]), URL_RULES).count() == 0
